"""Ordered licence signature rules.

A rule is (label, priority, confidence, keyword, regex). Regexes see lower-case words with one space between them and
around them; a match begins with the space before its first word, and the space after its last word is looked at only.
Priority 0 is strongest. Rules are written as lines below; ``{a|b}`` in a line stands for one rule per choice, so that
names times versions need not be spelled out.
"""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keyword: str
    regex: str


#: Phrases whose places are the base result, with their labels; they precede all rules.
BASE_PHRASES = (
    ("mit", "license", "under the mit license"),
    ("apache-2", "license", "apache license version 2"),
    ("cc-by-nc", "nc", "cc by nc"),
)

CONFIDENCE = (1.0, 0.95, 0.85, 0.6)

#: label ; priority ; keyword ; words (a regex over words; "_" stands for one space).
LINES = r"""
gpl-{1|2|3}.0-or-later ; 0 ; gnu ; gnu general public license (?:as published by the free software foundation )?(?:either )?version {1|2|3} (?:0 )?(?:of the license )?or (?:at your option )?any later version
gpl-{1|2|3}.0-only ; 1 ; gnu ; gnu general public license (?:gpl )?(?:v|version )?{1|2|3}(?: 0)?
gpl-{1|2|3}.0-only ; 1 ; gnu ; gnu gpl (?:license )?(?:v|version )?{1|2|3}(?: 0)?
gpl-{1|2|3}.0-only ; 2 ; gpl ; gpl(?: license)? (?:v|version )?{1|2|3}(?: 0)?
gpl-{1|2|3}.0-only ; 2 ; gplv{1|2|3} ; gplv{1|2|3}
gpl-{1|2|3}.0-or-later ; 1 ; gpl ; gpl (?:v|version )?{1|2|3}(?: 0)? or later
gpl-{1|2|3}.0-or-later ; 1 ; spdx ; spdx license identifier gpl {1|2|3} 0 or later
gpl-{1|2|3}.0-only ; 1 ; spdx ; spdx license identifier gpl {1|2|3} 0(?: only)?
gpl ; 3 ; gnu ; gnu general public license
gpl ; 3 ; gpl ; (?:under|the) (?:the )?gpl
lgpl-{2.1|2|3}-or-later ; 0 ; gnu ; gnu (?:lesser|library) general public license (?:as published by the free software foundation )?(?:either )?version {2 1|2|3} (?:0 )?(?:of the license )?or (?:at your option )?any later version
lgpl-{2.1|2|3} ; 1 ; gnu ; gnu (?:lesser|library) general public license (?:lgpl )?(?:v|version )?{2 1|2|3}(?: 0)?
lgpl-{2.1|2|3} ; 2 ; lgpl ; lgpl (?:v|version )?{2 1|2|3}(?: 0)?
lgpl-{2.1|2|3} ; 1 ; spdx ; spdx license identifier lgpl {2 1|2 0|3 0}(?: only| or later)?
lgpl ; 3 ; gnu ; gnu (?:lesser|library) general public license
lgpl ; 3 ; lgpl ; (?:under|the) (?:the )?lgpl
agpl-{1|3} ; 1 ; affero ; (?:gnu )?affero general public license (?:v|version )?{1|3}(?: 0)?(?: or (?:at your option )?(?:any )?later(?: version)?)?
agpl-{1|3} ; 2 ; agpl ; agpl (?:v|version )?{1|3}(?: 0)?
agpl ; 3 ; affero ; (?:gnu )?affero general public license
fdl-{1.1|1.2|1.3} ; 1 ; gnu ; gnu free documentation license (?:v|version )?{1 1|1 2|1 3}(?: or any later version)?
fdl ; 3 ; gnu ; gnu free documentation license
mit ; 0 ; permission ; permission is hereby granted free of charge to any person obtaining a copy of this software
mit ; 0 ; merchantability ; the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit ; 1 ; mit ; (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?mit(?: x11)? license
mit ; 1 ; spdx ; spdx license identifier mit
mit ; 2 ; mit ; the mit license(?: mit)?
mit ; 2 ; expat ; expat license
mit ; 3 ; mit ; mit licen[sc]ed?
mit-0 ; 1 ; mit ; mit no attribution(?: license)?
x11 ; 2 ; x11 ; x11 license
apache-{1|1.1|2}.0 ; 1 ; apache ; (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?apache (?:software )?license (?:v|version )?{1|1 1|2}(?: 0)?
apache-{1|1.1|2}.0 ; 2 ; apache ; apache (?:software )?license (?:v|version )?{1|1 1|2}(?: 0)?
apache-{1|1.1|2}.0 ; 2 ; apache ; apache {1|1 1|2}(?: 0)? license
apache-{1|1.1|2}.0 ; 1 ; spdx ; spdx license identifier apache {1 0|1 1|2 0}
apache-2.0 ; 0 ; apache ; you may obtain a copy of the license at http(?:s)? www apache org licenses license 2 0
apache-2.0 ; 0 ; compliance ; you may not use this file except in compliance with the license
apache ; 3 ; apache ; (?:the )?apache (?:software )?license
bsd-{2|3|4}-clause ; 1 ; bsd ; bsd {2|3|4} clause(?: license)?
bsd-{2|3|4}-clause ; 1 ; bsd ; {2|3|4} clause bsd(?: license)?
bsd-2-clause ; 2 ; bsd ; (?:simplified|freebsd) bsd license
bsd-3-clause ; 2 ; bsd ; (?:new|modified|revised) bsd license
bsd-4-clause ; 2 ; bsd ; (?:original|old) bsd license
bsd-3-clause ; 0 ; endorse ; may (?:not )?be used to endorse or promote products derived from this software without specific prior written permission
bsd-2-clause ; 0 ; redistribution ; redistribution and use in source and binary forms with or without modification are permitted
0bsd ; 1 ; bsd ; (?:zero clause bsd|bsd zero clause)(?: license)?
0bsd ; 1 ; 0bsd ; 0bsd(?: license)?
bsd ; 3 ; bsd ; bsd (?:style )?license
cc0-1.0 ; 1 ; cc0 ; cc0 1 0(?: universal)?
cc0-1.0 ; 2 ; creative ; creative commons (?:zero|cc0)(?: v| version)?(?: 1 0)?(?: universal)?
cc0-1.0 ; 3 ; cc0 ; cc0
cc-by-{1.0|2.0|2.5|3.0|4.0} ; 1 ; cc ; cc by {1 0|2 0|2 5|3 0|4 0}(?: international| unported| generic)?
cc-by-sa-{1.0|2.0|2.5|3.0|4.0} ; 1 ; cc ; cc by sa {1 0|2 0|2 5|3 0|4 0}(?: international| unported| generic)?
cc-by-nd-{1.0|2.0|2.5|3.0|4.0} ; 1 ; cc ; cc by nd {1 0|2 0|2 5|3 0|4 0}(?: international| unported| generic)?
cc-by-nc-{1.0|2.0|2.5|3.0|4.0} ; 1 ; cc ; cc by nc {1 0|2 0|2 5|3 0|4 0}(?: international| unported| generic)?
cc-by-nc-sa-{1.0|2.0|2.5|3.0|4.0} ; 1 ; cc ; cc by nc sa {1 0|2 0|2 5|3 0|4 0}(?: international| unported| generic)?
cc-by-nc-nd-{1.0|2.0|2.5|3.0|4.0} ; 1 ; cc ; cc by nc nd {1 0|2 0|2 5|3 0|4 0}(?: international| unported| generic)?
cc-by-nc-nd ; 2 ; cc ; cc by nc nd
cc-by-nc-sa ; 2 ; cc ; cc by nc sa
cc-by-sa ; 2 ; cc ; cc by sa
cc-by-nd ; 2 ; cc ; cc by nd
cc-by ; 3 ; cc ; (?:under|license) cc by
cc-by-{1.0|2.0|2.5|3.0|4.0} ; 1 ; creative ; creative commons attribution (?:license )?(?:v|version )?{1 0|2 0|2 5|3 0|4 0}
cc-by-sa-{1.0|2.0|2.5|3.0|4.0} ; 1 ; creative ; creative commons attribution share ?alike (?:license )?(?:v|version )?{1 0|2 0|2 5|3 0|4 0}
cc-by-nd-{1.0|2.0|2.5|3.0|4.0} ; 1 ; creative ; creative commons attribution no ?deriv(?:ative)?s? (?:works )?(?:license )?(?:v|version )?{1 0|2 0|2 5|3 0|4 0}
cc-by-nc-{1.0|2.0|2.5|3.0|4.0} ; 1 ; creative ; creative commons attribution non ?commercial (?:license )?(?:v|version )?{1 0|2 0|2 5|3 0|4 0}
cc-by-nc-sa-{1.0|2.0|2.5|3.0|4.0} ; 1 ; creative ; creative commons attribution non ?commercial share ?alike (?:license )?(?:v|version )?{1 0|2 0|2 5|3 0|4 0}
cc-by-nc-nd-{1.0|2.0|2.5|3.0|4.0} ; 1 ; creative ; creative commons attribution non ?commercial no ?deriv(?:ative)?s? (?:works )?(?:license )?(?:v|version )?{1 0|2 0|2 5|3 0|4 0}
cc-by-{1.0|2.0|2.5|3.0|4.0} ; 1 ; creativecommons ; creativecommons org licenses by {1 0|2 0|2 5|3 0|4 0}
cc-by-sa-{1.0|2.0|2.5|3.0|4.0} ; 1 ; creativecommons ; creativecommons org licenses by sa {1 0|2 0|2 5|3 0|4 0}
cc-by-nc-{1.0|2.0|2.5|3.0|4.0} ; 1 ; creativecommons ; creativecommons org licenses by nc {1 0|2 0|2 5|3 0|4 0}
cc-by-nc-sa-{1.0|2.0|2.5|3.0|4.0} ; 1 ; creativecommons ; creativecommons org licenses by nc sa {1 0|2 0|2 5|3 0|4 0}
cc-by-nc-nd-{1.0|2.0|2.5|3.0|4.0} ; 1 ; creativecommons ; creativecommons org licenses by nc nd {1 0|2 0|2 5|3 0|4 0}
cc0-1.0 ; 1 ; creativecommons ; creativecommons org publicdomain zero 1 0
creative-commons ; 3 ; creative ; creative commons(?: license)?
mpl-{1.0|1.1|2.0} ; 1 ; mozilla ; mozilla public license (?:mpl )?(?:v |version )?{1 0|1 1|2 0}
mpl-{1.0|1.1|2.0} ; 2 ; mpl ; mpl (?:v |version )?{1 0|1 1|2 0}
mpl-2.0 ; 0 ; mozilla ; this source code form is subject to the terms of the mozilla public license v 2 0
mpl ; 3 ; mozilla ; mozilla public license
epl-{1.0|2.0} ; 1 ; eclipse ; eclipse public license (?:v |version )?{1 0|2 0}
epl-{1.0|2.0} ; 2 ; epl ; epl (?:v |version )?{1 0|2 0}
epl ; 3 ; eclipse ; eclipse public license
cddl-{1.0|1.1} ; 1 ; common ; common development and distribution license (?:cddl )?(?:v |version )?{1 0|1 1}
cddl ; 3 ; common ; common development and distribution license
cpl-1.0 ; 1 ; common ; common public license (?:v |version )?1 0
cpl ; 3 ; common ; common public license
eupl-{1.0|1.1|1.2} ; 1 ; european ; european union public licen[sc]e (?:eupl )?(?:v |version )?{1 0|1 1|1 2}
eupl ; 3 ; european ; european union public licen[sc]e
artistic-{1.0|2.0} ; 1 ; artistic ; artistic license (?:v |version )?{1 0|2 0}
artistic ; 3 ; artistic ; artistic license
bsl-1.0 ; 1 ; boost ; boost software license(?: (?:v |version )?1 0)?
isc ; 1 ; isc ; (?:the )?isc license
isc ; 0 ; permission ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib ; 1 ; zlib ; (?:the )?zlib(?: libpng)? license
libpng ; 2 ; libpng ; libpng license
unlicense ; 0 ; unencumbered ; this is free and unencumbered software released into the public domain
unlicense ; 2 ; unlicense ; the unlicense
wtfpl ; 2 ; wtfpl ; wtfpl
postgresql ; 2 ; postgresql ; postgresql license
python-2.0 ; 1 ; python ; python software foundation license(?: version 2)?
openssl ; 2 ; openssl ; openssl license
php-{3.0|3.01} ; 1 ; php ; php license (?:v |version )?{3 0|3 01}
ruby ; 2 ; ruby ; (?:the )?ruby license
vim ; 2 ; vim ; vim license
w3c ; 2 ; w3c ; w3c (?:software )?(?:notice and )?license
ofl-{1.0|1.1} ; 1 ; sil ; sil open font license (?:v |version )?{1 0|1 1}
ofl ; 3 ; font ; open font license
odbl-1.0 ; 1 ; database ; open database license(?: (?:v |version )?1 0)?
odc-by-1.0 ; 1 ; commons ; open data commons attribution license(?: (?:v |version )?1 0)?
pddl-1.0 ; 1 ; public ; public domain dedication and license(?: (?:v |version )?1 0)?
ms-pl ; 1 ; microsoft ; microsoft public license
ms-rl ; 1 ; microsoft ; microsoft reciprocal license
ecl-2.0 ; 1 ; educational ; educational community license(?: (?:v |version )?2 0)?
osl-{1.0|2.0|2.1|3.0} ; 1 ; open ; open software license (?:v |version )?{1 0|2 0|2 1|3 0}
afl-{1.1|1.2|2.0|2.1|3.0} ; 1 ; academic ; academic free license (?:v |version )?{1 1|1 2|2 0|2 1|3 0}
lppl-{1.0|1.2|1.3} ; 1 ; latex ; latex project public license (?:v |version )?{1 0|1 2|1 3}c?
ncsa ; 1 ; illinois ; university of illinois (?:ncsa )?open source license
cecill-{1.0|2.0|2.1} ; 1 ; cecill ; cecill (?:free software license agreement )?(?:v |version )?{1 0|2 0|2 1}
busl-1.1 ; 1 ; business ; business source license(?: (?:v |version )?1 1)?
sspl-1.0 ; 1 ; server ; server side public license(?: (?:v |version )?1(?: 0)?)?
elastic-2.0 ; 1 ; elastic ; elastic license(?: (?:v |version )?2(?: 0)?)?
commons-clause ; 1 ; clause ; commons clause(?: license condition)?
openrail ; 1 ; openrail ; (?:creativeml |bigscience )?openrail(?: m)?(?: license)?
llama-community ; 1 ; llama ; llama (?:2 |3 )?community license(?: agreement)?
polyform-noncommercial ; 1 ; polyform ; polyform noncommercial license(?: 1 0 0)?
public-domain ; 2 ; public ; (?:released|dedicated|placed) (?:in|to|into) the public domain
public-domain ; 3 ; public ; public domain
proprietary ; 2 ; reserved ; all rights reserved
proprietary ; 1 ; proprietary ; proprietary and confidential
proprietary ; 1 ; prohibited ; unauthorized copying of this file via any medium is strictly prohibited
non-commercial ; 2 ; commercial ; (?:for )?non commercial (?:use|purposes) only
no-redistribution ; 2 ; redistribution ; redistribution is (?:strictly )?prohibited
spdx-tag ; 3 ; spdx ; spdx license identifier
generic-license ; 3 ; license ; (?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the |this )?license
"""


def expand(line: str) -> list[Rule]:
    """The rules of one line: the n-th choices of all its braces go together."""
    parts = re.split(r"\{([^{}]*)\}", line)
    choices = [part.split("|") for part in parts[1::2]]
    count = max((len(c) for c in choices), default=1)
    rules = []
    for i in range(count):
        text = "".join(itertools.chain.from_iterable(itertools.zip_longest(parts[::2], (c[i] for c in choices), fillvalue="")))
        label, priority, keyword, regex = (field.strip() for field in text.split(" ; "))
        rules.append(Rule(label, int(priority), CONFIDENCE[int(priority)], keyword, f" {regex}(?= )"))
    return rules


RULES: tuple[Rule, ...] = tuple(Rule(label, 0, 1.0, keyword, f" {phrase}(?= )") for label, keyword, phrase in BASE_PHRASES) + tuple(
    rule for line in LINES.strip().splitlines() for rule in expand(line)
)
KEYWORDS: tuple[str, ...] = tuple(sorted({rule.keyword for rule in RULES}))
