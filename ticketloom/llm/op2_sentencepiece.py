"""SentencePiece encoding and decoding of merge-type (BPE) models, without the library.

Encoding finds the one sequence of pieces that merging gives, by backtracking: at each position take the longest piece that
an Aho-Corasick automaton finds there, keep it if it is compatible with the piece before (merging the two pieces' text
gives exactly these two again; answers are remembered), else try the next shorter one; where none fits, mark the
position as failed in a bit field, so that it is never tried twice, and step back.

Texts are cut where no piece can reach across: before each space mark that follows another character (checked against the
vocabulary when the model is loaded) and around characters that the vocabulary lacks, which become byte pieces. Such
segments are encoded once as long as a table of bounded size holds them.

The model file is read directly (its protobuf fields), so the encoder needs no compiled model class.

Defined results: null text is empty, and its ids are the end id alone; rows with a repeated or null doc_id are encoded each on
their own and keep their doc_id.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from .common import Memory, held, map_texts, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Places for segments that a worker remembers.
REMEMBERED = 500_000
#: A word and the punctuation after it.
TAILED = re.compile(r"(?s)(.*[^\W\d_])(\W+)")


def varint(data: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        x |= (data[i] & 127) << shift
        shift += 7
        i += 1
        if data[i - 1] < 128:
            return x, i


def fields(data: bytes):
    """(number, value) of a protobuf message; values are ints or bytes."""
    i = 0
    while i < len(data):
        key, i = varint(data, i)
        if key & 7 == 0:
            x, i = varint(data, i)
        else:
            n, i = varint(data, i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            x, i = data[i : i + n], i + n
        yield key >> 3, x


class Model:
    """Pieces, scores and flags of a model file."""

    def __init__(self, path: str):
        import struct

        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        with open(path, "rb") as f:
            data = f.read()
        for number, value in fields(data):
            if number == 1:
                p = dict(fields(value))
                self.pieces.append(p[1].decode())
                self.scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                self.kinds.append(p.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        self.byte_fallback = bool(trainer.get(35, 0))
        if trainer.get(3, 1) != 2 or not self.byte_fallback or normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only merge-type models with byte pieces, a leading space mark, no character map and kept white space are covered")
        if USER in self.kinds:
            raise ValueError("user-defined pieces are not covered")
        self.eos = next(i for i, p in enumerate(self.pieces) if p == "</s>")
        self.rank = {p: -s for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True) if k == NORMAL}
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}


class Encoder:
    """encode(text) gives the ids, without an end id, and decode(ids) the text."""

    def __init__(self, path: str):
        self.m = m = Model(path)
        if any(a != MARK == b for p in m.id for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece reaches over the start of a word")
        self.pair: dict[int, bool] = {}
        self.auto = ahocorasick.Automaton()
        # A piece that merging never leaves whole (it has no way to come about) can't be in a result.
        self.halves: dict[str, tuple[str, str]] = {}
        for p in m.id:
            if self.merge(p, self.halves) == [p]:
                self.auto.add_word(p[::-1], (len(p), m.id[p]))
        self.auto.make_automaton()
        # A part comes to be at its rank; single characters are there from the start.
        self.born = {p: r if len(p) > 1 else -1.0 for p, r in m.rank.items()}
        # Where a piece ranks before one of its parts, births aren't in the order of ranks; such pieces are merged in earnest.
        self.early: set[str] = set()
        for p in sorted(self.halves, key=len):
            if any(self.born[h] >= self.born[p] or h in self.early for h in self.halves[p]):
                self.early.add(p)
        self.memory = Memory(REMEMBERED, self.learn)
        self.chars = {p for p in m.id if len(p) == 1}
        self.inside = {x for p in m.id for x in zip(p, p[1:], strict=False)}  # neighbours that a piece can join
        self.tails: dict[str, tuple[int, ...]] = {}
        # the first alternative is what nearly all segments are
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.text_of = [None if k == UNKNOWN else b"" if k in (CONTROL, UNUSED) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(m.pieces, m.kinds, strict=True)]
        self.is_byte = [k == BYTE for k in m.kinds]
        self.decimal = [str(i) for i in range(len(m.pieces))]

    def merge(self, text: str, halves: dict | None = None) -> list[str]:
        """What merging the best-ranked neighbours, leftmost first, makes of a short text; the last merge goes to halves."""
        parts, rank = list(text), self.m.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            if halves is not None and len(parts) == 2:
                halves[text] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, x: int, y: int) -> bool:
        """Whether merging the text of pieces x and y gives these two again."""
        if len(self.pair) > 1_000_000:
            self.pair.clear()
        a, b = self.m.pieces[x], self.m.pieces[y]
        ok = self.pair[x << 20 | y] = self.merge(a + b) == [a, b] if a in self.early or b in self.early else self.stays_apart(a, b)
        return ok

    def stays_apart(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a, b again. Merging works on a and b as it does on each alone, unless it joins a part
        x that ends a to a part y that starts b. The two parts stand side by side from the birth of the later one until
        either goes into its parent; their join is made if it ranks before both parents (or, as the left one of two equal
        joins is made first, with y's parent). The walk goes backwards in time through these parts."""
        rank, born, halves = self.m.rank, self.born, self.halves
        end_a = end_b = float("inf")
        while True:
            r = rank.get(a + b)
            if r is not None and r < end_a and r <= end_b:
                return False
            if born[a] > born[b] or (born[a] == born[b] and len(a) > 1):
                end_a, a = born[a], halves[a][1]
            elif len(b) > 1:
                end_b, b = born[b], halves[b][0]
            else:
                return True

    def matches(self, s: str) -> list[list[tuple[int, int]]]:
        """For each position (length, id) of the pieces that start there, longest first. The automaton runs over the
        reversed text, so that a match's end there is its start here."""
        last, found = len(s) - 1, [[] for _ in s]
        for end, match in self.auto.iter(s[::-1]):  # of those with one end, the longest comes first
            found[last - end].append(match)
        return found

    def backtrack(self, s: str) -> list[int]:
        """The ids of the pieces of a text whose characters are all in the vocabulary."""
        n, found, failed, pair = len(s), self.matches(s), 0, self.pair
        out: list[int] = []
        starts, tried = [0], [0]  # tried[k]: how many of the pieces at the k-th start have been tried
        while starts[-1] < n:
            at, i = starts[-1], tried[-1]
            before = out[-1] << 20 if out else 0
            for length, piece in found[at][i:] if i else found[at]:
                i += 1
                if failed and failed >> at + length & 1:
                    continue
                if out:
                    ok = pair.get(before | piece)
                    if ok is None:
                        ok = self.fits(out[-1], piece)
                    if not ok:
                        continue
                tried[-1] = i
                out.append(piece)
                starts.append(at + length)
                tried.append(0)
                break
            else:
                if not out:
                    raise AssertionError(f"no encoding of {s!r}")
                failed |= 1 << at
                tried.pop()
                starts.pop()
                out.pop()
        return out

    def segment(self, s: str) -> tuple[int, ...]:
        """The ids of a text without inner word starts."""
        if self.chars.issuperset(s):
            return tuple(self.backtrack(s))
        ids, run = [], ""
        for c in s + "\0":  # characters that the vocabulary lacks part the text; the last one only ends the run
            if c in self.chars:
                run += c
            else:
                ids += self.backtrack(run)
                run = ""
                ids += map(self.m.bytes.__getitem__, c.encode())
        return tuple(ids[:-1])

    def learn(self, keys: list[str]) -> list[tuple[int, ...]]:
        """The ids of each segment; the mark before a word may be left out. A word is cut before its punctuation where no piece
        joins the two, so that it is encoded once for all that follows it."""
        cuts = [None if (x := TAILED.fullmatch(s)) is None or (x[1][-1], x[2][0]) in self.inside or MARK in x[2] else (x[1], x[2]) for s in keys]
        heads = iter(self.memory.values([x[0] for x in cuts if x]))
        return [next(heads) + self.tail(x[1]) if x else self.segment(s if s[:1] in (MARK, "\n") else MARK + s) for s, x in zip(keys, cuts, strict=True)]

    def tail(self, s: str) -> tuple[int, ...]:
        if s not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[s] = self.segment(s)
        return self.tails[s]

    def segments(self, text: str) -> list[str]:
        """Keys of learn(). Where single spaces part all words, the words are; a new line that the vocabulary lacks starts one."""
        if not text:
            return []
        lines = text if "\n" in self.chars else text.replace("\n", " \n")
        if "  " in lines or MARK in lines or text[0] == " " or "\n" in self.chars and "\n" in text:
            return self.cut.findall(MARK + text.replace(" ", MARK))
        return lines.split(" ")

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.memory.values(self.segments(text))))

    def decoded(self, ids: list[int]) -> bytes:
        """decode() as UTF-8. Ids of whole characters are put together as they are; others go the long way."""
        try:
            raw = b"".join(map(self.text_of.__getitem__, ids))
            if not ids or self.m.kinds[ids[0]] in (NORMAL, BYTE):
                raw.decode()
                return raw[1:] if raw.startswith(b" ") and self.m.kinds[ids[0]] == NORMAL else raw
        except (TypeError, UnicodeDecodeError):  # an unknown id, or byte pieces that are no text
            pass
        return self.decode(ids).encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces are put together, invalid bytes become U+FFFD each, and the leading mark goes."""
        out, run, first = [], bytearray(), True
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.text_of[i]
                first = False
                continue
            if run:
                out.append(readable(bytes(run)))
                run = bytearray()
            if i is None:
                break
            piece = self.text_of[i].decode() if self.m.kinds[i] != UNKNOWN else " ⁇ "
            if first and self.m.kinds[i] not in (CONTROL, UNUSED):
                piece, first = piece[1:] if piece.startswith(" ") and self.m.kinds[i] == NORMAL else piece, False
            out.append(piece)
        return "".join(out)

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text."""
        return len(ids), hashlib.sha256(" ".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(self.decoded(ids)).hexdigest()


def readable(raw: bytes) -> str:
    """UTF-8, with U+FFFD for each byte that isn't part of a valid character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        i += n
    return "".join(out)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    return held(Encoder, path)


def encoded(docs: DataFrame, path: str | None = None, columns: tuple[str, ...] = ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """doc_id and the named columns: ids array<int> (with the end id), decoded (the text of these ids), their number and digests; one
    row for each row of docs. path: a model file that is installed on every executor, like the tokenizer package itself."""
    at = path or model_path()
    kinds = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}

    def rows(doc_ids, texts):
        e, out = encoder(at), {"doc_id": doc_ids} | {c: [] for c in columns}
        for t in texts:
            ids = [*e.encode(t.decode()), e.m.eos]
            got = dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), e.digests(ids), strict=True)) if len(columns) > 2 else {}
            for c in columns:
                out[c].append(ids if c == "ids" else e.decoded(ids).decode() if c == "decoded" else got[c])
        return out

    return map_texts(docs, ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in columns)]), rows)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), columns=("n_tokens", "ids_sha256", "decoded_sha256"))
