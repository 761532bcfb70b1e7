"""BPE encoding and decoding by traversal of a trie of distinct words.

In byte pair encoding the encoding of a prefix is fixed by its last token alone: the encoding of prefix p ends in the
token t that is a suffix of p such that the last token of the rest may stand before t, that is, that no merge crosses
the seam before the merges inside the two tokens are done. So each node of a trie of symbols (a prefix of words) holds one
state, its last token, found from the states of its ancestors. The distinct words of a chunk of texts are inserted into
a trie, and one depth-first walk sets each node's state once for all words that share its prefix. A word's ids are read
back from its end, token by token. Texts are joins of their words' ids.

The vocabulary file is read on the driver and its tables are sent to the tasks (their size is that of the vocabulary,
whatever the data). A task holds one chunk's trie and the ids of up to KEPT pieces of LONGEST letters at most, so memory is
bounded; what it kept is freed when it ends.

Defined cases: null and empty texts have no tokens and decode to ""; repeated rows give repeated results; other columns
stay, and result columns take the place of columns of the same name.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters of texts whose new words go into one trie.
CHUNK = 500_000
#: Pieces of texts whose ids a task keeps, about, and the longest that it keeps.
KEPT = 160_000
LONGEST = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for byte in range(256):
        if byte in printable:
            letters.append(chr(byte))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a tokenizer file with word ends: ids, merge ranks, and its special tokens."""

    ids: dict[str, int]
    merges: dict[tuple[str, str], int]
    special: dict[str, int]
    end: str
    pattern: str

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        merges = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        return cls(model["vocab"], merges, special, model["end_of_word_suffix"] or "", splits[0])


class Seams:
    """Which tokens may follow each other: (a, b) may if encoding their joined symbols gives just a and b."""

    def __init__(self, vocabulary: Vocabulary):
        self.rank, self.end = vocabulary.merges, vocabulary.end
        self.parts: dict[str, tuple[str, str]] = {}
        self.made: dict[str, int] = {}
        for (left, right), rank in self.rank.items():
            if left + right not in self.made:  # the first rank that makes a token is the one that encoding uses
                self.parts[left + right] = (left, right)
                self.made[left + right] = rank
        #: Tokens that encoding can end in, with their ids.
        self.ids = {t: i for t, i in vocabulary.ids.items() if self._reached(t)}
        self.names = {i: t for t, i in self.ids.items()}

    def _reached(self, token: str) -> bool:
        """Whether merging the token's own symbols, lowest rank first, ends in the token."""
        ends = bool(self.end) and token.endswith(self.end)
        bare = token[: -len(self.end)] if ends else token
        symbols = [*bare[:-1], bare[-1] + self.end] if ends and bare else list(bare) or [token]
        while len(symbols) > 1:
            best, i = min((self.rank.get(pair, float("inf")), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if best == float("inf"):
                return False
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return True

    def may_follow(self, left: int, right: int) -> bool:
        """Undo the merges of both sides from the last to the first; at each moment the tokens at the seam must not
        merge before the merge that was undone last on either side took place."""
        edge_left, edge_right, before = self.names[left], self.names[right], float("inf")
        while True:
            across = self.rank.get((edge_left, edge_right))
            if across is not None and across < before:
                return False
            made_left, made_right = self.made.get(edge_left, -1), self.made.get(edge_right, -1)
            if made_left < 0 and made_right < 0:
                return True
            # Of equal ranks the one to the left is done first, so the one to the right is undone first; a merge across
            # the seam of that same rank comes after the left side's and before the right side's.
            if made_left > made_right:
                before, edge_left = made_left, self.parts[edge_left][1]
            else:
                before, edge_right = made_right + 0.5, self.parts[edge_right][0]


class WordTrie:
    """A trie of distinct words. Symbols are letters; the last one of a word has the end mark, so words are its leaves."""

    def __init__(self, seams: Seams, known: dict[int, bool]):
        self.seams, self.known, self.root = seams, known, {}
        self.longest = max(len(t.removesuffix(seams.end)) for t in seams.ids)

    def insert(self, word: str) -> None:
        node = self.root
        for letter in word[:-1]:
            child = node.get(letter)
            if child is None:
                child = node[letter] = {}
            node = child
        node[word[-1] + self.seams.end] = None

    def encodings(self) -> Iterator[tuple[str, list[int]]]:
        """Every word with its ids, by a depth-first walk.

        For each depth of the path from the root the walk holds the last token of that prefix's encoding and where it
        starts; what stands before a token is the encoding of a shorter prefix on the same path.
        """
        get, known, may_follow, end, longest = self.seams.ids.get, self.known, self.seams.may_follow, self.seams.end, self.longest
        last, begins = [0], [0]
        path = [iter(self.root.items())]
        prefixes = [""]
        while path:
            entry = next(path[-1], None)
            if entry is None:
                path.pop()
                prefixes.pop()
                continue
            symbol, child = entry
            depth = len(path)
            prefix = prefixes[-1] + symbol
            # Just one suffix fits; it is mostly short, so short ones come first.
            for start in range(depth - 1, depth - longest - 1 if depth > longest else -1, -1):
                token = get(prefix[start:])
                if token is None:
                    continue
                if start:
                    seam = last[start] << 32 | token
                    follows = known.get(seam)
                    if follows is None:
                        follows = known[seam] = may_follow(last[start], token)
                    if not follows:
                        continue
                break
            else:
                raise ValueError(f"no encoding of {prefix!r}")
            if child is None:
                ids = [token]
                while start:
                    ids.append(last[start])
                    start = begins[start]
                yield prefix[: len(prefix) - len(end)], ids[::-1]
                continue
            del last[depth:], begins[depth:]
            last.append(token)
            begins.append(start)
            path.append(iter(child.items()))
            prefixes.append(prefix)


def lower(text: str) -> str:
    """Lower case letter by letter: no letter's form depends on those beside it."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


#: str.split() also splits at these, which are no white space to the tokenizer.
INFORMATION_SEPARATORS = regex.compile("[\x1c-\x1f]")


class Recent:
    """Ids of strings of up to LONGEST letters; when there are ``most``, those not asked for since the last time go."""

    def __init__(self, most: int):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = most

    def __len__(self) -> int:
        return len(self.young) + len(self.old)

    def get(self, key: str) -> bytes | None:
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.young[key] = value
        return value

    def keep(self, key: str, value: bytes) -> None:
        if len(key) <= LONGEST:
            self.young[key] = value

    def turn(self) -> None:
        if len(self.young) > self.most // 2:
            self.old, self.young = self.young, {}


class TextCodec:
    """Encodes and decodes whole texts, many at a time.

    Normal form and lower case never reach across white space, and words hold none, so a text's ids are those of what
    stands between its white space. Those of each such piece are kept, up to a bound.
    """

    def __init__(self, vocabulary: Vocabulary, seams: Seams | None = None, kept: int = KEPT):
        self.seams, self.kept = seams or Seams(vocabulary), kept
        self.words = regex.compile(vocabulary.pattern)
        self.special = vocabulary.special
        self.at_special = regex.compile("|".join(regex.escape(s) for s in vocabulary.special)) if vocabulary.special else None
        self.tokens = {i: t for t, i in vocabulary.ids.items()} | {i: t for t, i in vocabulary.special.items()}
        self.letters = byte_letters()
        self.direct = {letter for letter in self.letters if ord(letter) < 128}
        self.known, self.pieces = Recent(kept), Recent(kept)
        self.seams_known: dict[int, bool] = {}

    def _parts(self, text: str | None) -> list[str]:
        """Pieces of a text and the special tokens in it, whose strings stand for themselves."""
        if not text:
            return []
        split = (lambda t: regex.split(r"\s+", t)) if INFORMATION_SEPARATORS.search(text) else str.split
        if self.at_special is None or not self.at_special.search(text):
            return split(text)
        parts, at = [], 0
        for found in self.at_special.finditer(text):
            parts += [*split(text[at : found.start()]), found[0]]
            at = found.end()
        return [*parts, *split(text[at:])]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces: their new words go into a trie, whose walk encodes them."""
        find = self.words.findall
        if len(self.seams_known) > 2 * self.kept:
            self.seams_known.clear()
        wordy = {p: find(lower(unicodedata.normalize("NFC", p))) for p in pieces if p not in self.special}
        trie, spelled, known = WordTrie(self.seams, self.seams_known), {}, {}
        for word in {w for words in wordy.values() for w in words}:
            ids = self.known.get(word)
            if ids is not None:
                known[word] = ids
                continue
            letters = word if self.direct.issuperset(word) else "".join(map(self.letters.__getitem__, word.encode()))
            spelled[letters] = word
            trie.insert(letters)
        for letters, ids in trie.encodings():
            known[spelled[letters]] = array("I", ids).tobytes()
            self.known.keep(spelled[letters], known[spelled[letters]])
        learnt = {piece: b"".join(map(known.__getitem__, words)) for piece, words in wordy.items()}
        for piece in pieces & self.special.keys():
            learnt[piece] = array("I", [self.special[piece]]).tobytes()
        return learnt

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Memory holds CHUNK characters of texts, or one."""
        chunk, held = [], 0
        for text in texts:
            chunk.append(self._parts(text))
            held += len(text or "")
            if held > CHUNK:
                yield from self._encode_chunk(chunk)
                chunk, held = [], 0
        yield from self._encode_chunk(chunk)

    def forget(self) -> None:
        self.pieces, self.known = Recent(self.kept), Recent(self.kept)
        self.seams_known.clear()

    def _encode_chunk(self, chunk: list[list[str]]) -> Iterator[bytes]:
        found = {piece: self.pieces.get(piece) for piece in set().union(*chunk)}
        learnt = self._learn({piece for piece, ids in found.items() if ids is None})
        found |= learnt
        for piece, ids in learnt.items():
            self.pieces.keep(piece, ids)
        self.pieces.turn()
        self.known.turn()
        get = found.__getitem__
        for parts in chunk:
            yield b"".join(map(get, parts))

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        """Token strings joined by one space, as a tokenizer without a decoder does."""
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


_CODECS: dict[str, TextCodec] = {}


def codec(key: str, vocabulary: Vocabulary, seams: Seams) -> TextCodec:
    """One codec for each worker process and vocabulary."""
    if key not in _CODECS:
        _CODECS[key] = TextCodec(vocabulary, seams)
    return _CODECS[key]


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and, as asked for, ids (array of long) and decoded (text).

    ``path`` is a tokenizer file on the driver.
    """
    vocabulary = Vocabulary.load(path)
    handle = docs.sparkSession.sparkContext.broadcast((vocabulary, Seams(vocabulary)))
    added = {"n_tokens": (T.LongType(), pa.int64()), "ids_sha256": (T.StringType(), pa.string()), "decoded_sha256": (T.StringType(), pa.string())}
    if with_ids:
        added["ids"] = (T.ArrayType(T.LongType()), pa.list_(pa.int64()))
    if with_text:
        added["decoded"] = (T.StringType(), pa.string())
    kept = [f.name for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([docs.schema[n] for n in kept] + [T.StructField(n, kind) for n, (kind, _) in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = codec(path, *handle.value)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in added}
            for ids in mine.encode_all(text.as_py() for text in batch.column(text_col)):
                decoded = mine.decode(ids)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out["ids"].append(array("I", ids).tolist())
                if with_text:
                    out["decoded"].append(decoded)
            columns = [batch.column(n) for n in kept] + [pa.array(out[n], kind) for n, (_, kind) in added.items()]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])
        mine.forget()

    return docs.mapInArrow(run, schema)
