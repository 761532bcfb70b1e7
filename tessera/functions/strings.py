"""Vectorised string functions in code points. Each is a Catalyst expression; NULL stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def str_len(s: Column) -> Column:
    return F.char_length(s)


def add(a: Column, b) -> Column:
    return F.concat(a, _lit(b))


def multiply(s: Column, n: int) -> Column:
    return F.repeat(s, n)


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 2**31 - 1)))


def swapcase(s: Column) -> Column:
    """Letters of one case become those of the other."""
    letters = F.split(s, "")
    return F.array_join(F.transform(letters, lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c))), "")


def title(s: Column) -> Column:
    """First letter of each run of letters in upper case, the others in lower case."""
    pieces = F.regexp_extract_all(s, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 2**31 - 1)))), "")


def strip(s: Column, chars: str | None = None) -> Column:
    return lstrip(rstrip(s, chars), chars)


def lstrip(s: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(s, rf"^{_class(chars)}+", "")


def rstrip(s: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(s, rf"{_class(chars)}+$", "")


def _class(chars: str | None) -> str:
    return r"\s" if chars is None else "[" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]"


def ljust(s: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.char_length(s) >= width, s).otherwise(F.rpad(s, width, fill))


def rjust(s: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.char_length(s) >= width, s).otherwise(F.lpad(s, width, fill))


def center(s: Column, width: int, fill: str = " ") -> Column:
    """Odd room goes to the left if the width is odd, else to the right."""
    room = F.greatest(F.lit(width) - F.char_length(s), F.lit(0))
    left = (F.floor(room / 2) + F.when((room % 2 == 1) & F.lit(width % 2 == 1), 1).otherwise(0)).cast("int")
    return F.concat(F.repeat(F.lit(fill), left), s, F.repeat(F.lit(fill), (room - left).cast("int")))


def zfill(s: Column, width: int) -> Column:
    signed = F.startswith(s, F.lit("-")) | F.startswith(s, F.lit("+"))
    body = F.when(signed, F.substring(s, 2, 2**31 - 1)).otherwise(s)
    sign = F.when(signed, F.substring(s, 1, 1)).otherwise("")
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.char_length(s), F.lit(0)))
    return F.concat(sign, zeros, body)


def find(s: Column, sub: str) -> Column:
    """Place of the first occurrence, -1 for none."""
    return F.instr(s, sub) - 1


def rfind(s: Column, sub: str) -> Column:
    at = F.instr(F.reverse(s), sub[::-1])
    return F.when(at == 0, -1).otherwise(F.char_length(s) - at - len(sub) + 1).cast("int")


def count(s: Column, sub: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.char_length(s) - F.char_length(F.replace(s, F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def startswith(s: Column, prefix: str) -> Column:
    return F.startswith(s, F.lit(prefix))


def endswith(s: Column, suffix: str) -> Column:
    return F.endswith(s, F.lit(suffix))


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def split(s: Column, sep: str | None = None) -> Column:
    """Parts between separators; without one, runs of white space, none at the ends."""
    if sep is None:
        return F.filter(F.split(s, r"\s+"), lambda p: p != "")
    return F.split(s, "\\Q" + sep + "\\E", -1)


def splitlines(s: Column) -> Column:
    return F.split(F.regexp_replace(s, r"(\r\n|\n|\r|\x0b|\x0c|\x1c|\x1d|\x1e|\x85| | )\z", ""), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", -1)


def partition(s: Column, sep: str) -> Column:
    """Before, separator, after; the whole string first if there is no separator."""
    at = F.instr(s, sep)
    return F.when(at == 0, F.array(s, F.lit(""), F.lit(""))).otherwise(F.array(F.substring(s, F.lit(1), at - 1), F.lit(sep), F.substring(s, at + len(sep), F.char_length(s))))


def rpartition(s: Column, sep: str) -> Column:
    at = rfind(s, sep)
    return F.when(at < 0, F.array(F.lit(""), F.lit(""), s)).otherwise(F.array(F.substring(s, F.lit(1), at), F.lit(sep), F.substring(s, at + 1 + len(sep), F.char_length(s))))


def join(sep: str, parts: Column) -> Column:
    return F.array_join(parts, sep)


def expandtabs(s: Column, size: int = 8) -> Column:
    """Tabs to the next multiple of ``size``, columns counted from the last line break: a fold over the letters."""
    step = lambda acc, c: F.when(c == "\t", F.struct(F.concat(acc["s"], F.repeat(F.lit(" "), (size - acc["n"] % size).cast("int"))).alias("s"), (acc["n"] + size - acc["n"] % size).alias("n"))).otherwise(
        F.struct(F.concat(acc["s"], c).alias("s"), F.when((c == "\n") | (c == "\r"), 0).otherwise(acc["n"] + 1).alias("n"))
    )
    return F.aggregate(F.split(s, ""), F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), step, lambda acc: acc["s"])


def translate(s: Column, source: str, target: str) -> Column:
    return F.translate(s, source, target)


def cut(s: Column, start: int, stop: int) -> Column:
    """Code points start to stop, both counted from 0."""
    return F.substring(s, start + 1, max(0, stop - start))


def _all_of(s: Column, pattern: str) -> Column:
    return F.rlike(s, F.lit(rf"\A(?:{pattern})+\z"))


def isalpha(s: Column) -> Column:
    return _all_of(s, r"\p{L}")


def isdigit(s: Column) -> Column:
    return _all_of(s, r"[\p{Nd}²³¹]")


def isdecimal(s: Column) -> Column:
    return _all_of(s, r"\p{Nd}")


def isnumeric(s: Column) -> Column:
    return _all_of(s, r"\p{N}")


def isalnum(s: Column) -> Column:
    return _all_of(s, r"[\p{L}\p{N}]")


def isspace(s: Column) -> Column:
    return _all_of(s, r"[\s\x1c-\x1f\x85\p{Z}]")


def isupper(s: Column) -> Column:
    return F.rlike(s, F.lit(r"\p{Lu}")) & ~F.rlike(s, F.lit(r"[\p{Ll}\p{Lt}]"))


def islower(s: Column) -> Column:
    return F.rlike(s, F.lit(r"\p{Ll}")) & ~F.rlike(s, F.lit(r"[\p{Lu}\p{Lt}]"))


def istitle(s: Column) -> Column:
    return F.rlike(s, F.lit(r"\p{L}")) & (s == title(s))


def encode(s: Column, charset: str = "UTF-8") -> Column:
    return F.encode(s, charset)


def decode(b: Column, charset: str = "UTF-8") -> Column:
    return F.decode(b, charset)


def rsplit(s: Column, sep: str, most: int | None = None) -> Column:
    """Parts between separators; ``most`` cuts at most, those furthest to the right."""
    parts = split(s, sep)
    if most is None:
        return parts
    head = lambda p: F.greatest(F.size(p) - most, F.lit(1))
    return F.get(F.transform(F.array(parts), lambda p: F.concat(F.array(F.array_join(F.slice(p, F.lit(1), head(p)), sep)), F.slice(p, head(p) + 1, F.size(p)))), F.lit(0))


def _found(at: Column) -> Column:
    return F.when(at < 0, F.raise_error(F.lit("substring not found"))).otherwise(at).cast("int")


def index(s: Column, sub: str) -> Column:
    """``find``, but an error where there is none."""
    return _found(find(s, sub))


def rindex(s: Column, sub: str) -> Column:
    return _found(rfind(s, sub))


def mod(template: str, *values: Column) -> Column:
    """A printf template filled in with columns."""
    return F.format_string(template, *values)


#: Comparisons by code point; ``compare`` leaves out white space at both right ends first.
COMPARISONS = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def compare(a: Column, b, op: str, trim: bool = True) -> Column:
    a, b = (rstrip(x) if trim else x for x in (a, _lit(b)))
    return getattr(a, COMPARISONS[op])(b)


def maketrans(source: str, target: str, gone: str = "") -> tuple[str, str]:
    """Arguments of ``translate``: letters of ``source`` become those of ``target``, letters of ``gone`` vanish."""
    if len(source) != len(target):
        raise ValueError("source and target differ in length")
    kept = [(a, b) for a, b in zip(source, target) if a not in gone]
    return "".join(a for a, _ in kept) + gone, "".join(b for _, b in kept)
