"""Byte-level BPE by tree concatenation.

A text is halved until its pieces are short, wherever the cuts fall. The pieces are encoded by themselves, and neighbours are joined up the tree. A join
keeps what is far from the cut and encodes a window around it anew, which grows until both sides agree:

* Between two places at which the text is split whatever stands around (a letter before a space, a digit before a letter, ...) nothing outside
  matters, so a window that reaches from one such place to another is exact. In most text this is a word or two.
* Text that is not split for long, such as a run of letters, is compared inside: a window of the last and first few ids is encoded as bytes, and grows
  until its first id is the left side's and its last id the right side's. Each two neighbours of the result are then neighbours of some encoding, and
  a sequence of ids in which each two neighbours would stay as they are is the encoding itself. At worst the window is the whole run.

Texts up to a part's length are done where they are, in one narrow pass. Longer ones are cut into parts that are dealt over all tasks, and the parts'
ids meet by document for the joins. Ids come from the vocabulary's merge ranks, splits from the tokenizer's own splitter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import per_document, table
from .packing import TOKENIZER, _tools

#: Characters of a piece that is encoded at once, and of a part that goes to a task of its own.
LEAF, PART = 2048, 1 << 16
#: Ids on either side of a join that are looked at first, and characters of a window that is encoded without comparing inside.
LOOK, SHORT = 16, 512

# Places that split a text in any context. Letters are of blocks that every version of Unicode knows alike; an apostrophe may start a contraction.
_L, _N, _O, _S = r"A-Za-zÀ-ÖØ-öø-ɏА-яぁ-ゖ一-龥", "0-9", r"!-\&(-/:-@\[-`{-~", r" \t\n\r"
SAFE = regex.compile(rf"(?<=[{_L}{_N}{_O}'])(?=[{_S}])|(?<=[{_L}])(?=[{_N}{_O}'])|(?<=[{_N}])(?=[{_L}{_O}'])|(?<=[{_O}])(?=[{_L}{_N}])")
#: Bytes that continue a character.
INSIDE = bytes(range(0x80, 0xC0))
_worker: dict = {}


class Coder:
    """Encoding and decoding with one vocabulary; leaf and look are set lower in tests."""

    def __init__(self, name: str = TOKENIZER, leaf: int = LEAF, look: int = LOOK, short: int = SHORT) -> None:
        self.leaf, self.look, self.short = leaf, look, short
        own, self.fast, _ = _tools(name)
        self.special = {t.content: i for i, t in own.get_added_tokens_decoder().items()}
        self.special_ids = np.array(sorted(self.special.values()), np.uint32)
        self._marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._splitter = own.pre_tokenizer
        n = max(self.fast.n_vocab, *(i + 1 for i in self.special.values()), 1)
        self.bytes = [b""] * n
        for piece, i in self.fast._mergeable_ranks.items():
            self.bytes[i] = piece
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.decimal = [str(i) for i in range(n)]

    def raw(self, ids: np.ndarray) -> bytes:
        own = self.bytes
        return b"".join([own[i] for i in ids.tolist() if i < len(own)])

    def text(self, ids: np.ndarray) -> str:
        """What ids stand for; bytes that are no text become the replacement character, ids that the vocabulary lacks nothing."""
        return self.raw(ids).decode("utf-8", "replace")

    def _bytes_ids(self, piece: bytes) -> np.ndarray:
        return np.array(self.fast._encode_single_piece(piece), np.uint32)

    def _spans(self, text: str) -> list[tuple[int, int]]:
        return [span for _, span in self._splitter.pre_tokenize_str(text)]

    def encode(self, text: str) -> np.ndarray:
        """The ids of text. Strings of special tokens are cut out first, as the tokenizer does; nothing merges across them."""
        marks = list(self._marks.finditer(text)) if self._marks else []
        if not marks:
            return self._tree(text)
        out, at = [], 0
        for m in marks:
            out += [self._tree(text[at : m.start()]), np.array([self.special[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, self._tree(text[at:])])

    def _tree(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self.fast.encode_to_numpy(text).astype(np.uint32, copy=False)
        half = len(text) // 2
        return self.join(self._tree(text[:half]), self._tree(text[half:]))

    def folded(self, parts: list[np.ndarray]) -> np.ndarray:
        """Neighbouring parts of a text joined as a tree."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else np.empty(0, np.uint32)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of the text that a and b are the two halves of; a and b are encodings of whole characters."""
        if not len(a) or not len(b):
            return a if len(a) else b
        look = self.look
        while True:
            left, right, at_start, at_end = self._ends(a, b, look)
            x, y = self.raw(left), self.raw(right)
            lead = len(x) - len(x.lstrip(INSIDE))  # a token may start inside a character
            tail = next((k for k in range(1, 4) if k <= len(y) and y[-k] >= 0xC0 and len(y[-k:]) < (2 if y[-k] < 0xE0 else 3 if y[-k] < 0xF0 else 4)), 0)
            s, t = x[lead:].decode(), y[: len(y) - tail].decode()
            cut, both = len(s), s + t
            p = 0 if at_start else None
            for m in SAFE.finditer(both, 0, cut + 1):
                p = m.start()
            m = SAFE.search(both, cut) if cut else None
            q = m.start() if m else len(both) if at_end else None
            if p is not None and q is not None:
                break
            look *= 4
        i, j = self._count(left, len(both[p:cut].encode()), last=True), self._count(right, len(both[cut:q].encode()), last=False)
        keep, rest = a[: len(a) - i], b[j:]
        middle = both[p:q]
        if len(middle) <= self.short:
            window = self.fast.encode_to_numpy(middle).astype(np.uint32, copy=False)
        else:
            window = self._unsplit(middle, cut - p, a[len(a) - i :], b[:j])
        return np.concatenate([keep, window, rest])

    def _ends(self, a: np.ndarray, b: np.ndarray, look: int) -> tuple[np.ndarray, np.ndarray, bool, bool]:
        """The last ids of a and the first of b, none beyond a special token, and whether that is all there is."""
        left, right = a[-look:], b[:look]
        at_start, at_end = len(left) == len(a), len(right) == len(b)
        if len(hard := np.flatnonzero(np.isin(left, self.special_ids))):
            left, at_start = left[hard[-1] + 1 :], True
        if len(hard := np.flatnonzero(np.isin(right, self.special_ids))):
            right, at_end = right[: hard[0]], True
        return left, right, at_start, at_end

    def _count(self, ids: np.ndarray, n: int, last: bool) -> int:
        """How many ids at one end make n bytes."""
        sums = np.cumsum(self.lengths[ids[::-1] if last else ids])
        return int(np.searchsorted(sums, n)) + 1 if n else 0

    def _unsplit(self, text: str, cut: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of text, a long window that is split in few places or none; a and b are the ids of its sides."""
        before, after = {s: e for s, e in self._spans(text[:cut])}, {s + cut: e + cut for s, e in self._spans(text[cut:])}
        at, sums_a, sums_b = 0, np.concatenate([[0], np.cumsum(self.lengths[a])]), np.concatenate([[0], np.cumsum(self.lengths[b])])
        cut_byte = int(sums_a[-1])
        out = []
        for s, e in self._spans(text):
            piece = text[s:e].encode()
            end = at + len(piece)
            if before.get(s) == e:
                out.append(a[np.searchsorted(sums_a, at) : np.searchsorted(sums_a, end)])
            elif after.get(s) == e:
                out.append(b[np.searchsorted(sums_b, at - cut_byte) : np.searchsorted(sums_b, end - cut_byte)])
            elif before.get(s) == cut and after.get(cut) == e:
                out.append(self._across(a[np.searchsorted(sums_a, at) :], b[: np.searchsorted(sums_b, end - cut_byte)]))
            else:
                out.append(self._bytes_ids(piece))
            at = end
        return np.concatenate(out)

    def _across(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of one unsplit piece from those of its sides: the window doubles until its first id is a's and its last id b's."""
        look = self.look
        while True:
            i, j = min(look, len(a)), min(look, len(b))
            window = self._bytes_ids(self.raw(a[len(a) - i :]) + self.raw(b[:j]))
            if (i == len(a) or window[0] == a[len(a) - i]) and (j == len(b) or window[-1] == b[j - 1]):
                return np.concatenate([a[: len(a) - i], window, b[j:]])
            look *= 2


def coder(name: str) -> Coder:
    if name not in _worker:
        _worker[name] = Coder(name)
    return _worker[name]


def cuts(text: str, part: int, special: list[str]) -> list[int]:
    """Where text is cut into parts of equal length, at most part each, none inside a special token's string."""
    n = 1
    while len(text) > part * n:
        n *= 2
    out = [0]
    for k in range(1, n):
        at = len(text) * k // n
        for s in special:
            found = text.find(s, max(0, at - len(s) + 1), at + len(s) - 1)
            at = found if 0 <= found < at else at
        out.append(max(at, out[-1]))
    return [*out, len(text)]


def encode(docs: DataFrame, name: str = TOKENIZER, part: int = PART) -> DataFrame:
    """(doc_id, ids binary) of each row of docs: the ids of its whole text, 4 little-endian bytes each, as the tokenizer gives them without special tokens
    of its own; a special token's string in a text becomes its id.

    Null and empty texts have no ids. Rows that repeat, with or without a doc_id, come back as often. No documents, no rows; other columns aren't
    read. A text's ids are one value, so a text holds at most some 500 million tokens.
    """

    def whole(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = coder(name)
        for doc_id, text in rows:
            yield doc_id, own.encode(text or "").tobytes()

    def parted(rows: Iterator[tuple]) -> Iterator[tuple]:
        special = list(coder(name).special)
        for doc_id, text in rows:
            key, at = hashlib.sha256(text.encode()).digest(), cuts(text, part, special)
            for k, (lo, hi) in enumerate(zip(at, at[1:])):
                yield doc_id, key, k, text[lo:hi]

    def encoded(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = coder(name)
        for doc_id, key, k, text in rows:
            yield doc_id, key, k, own.encode(text).tobytes()

    def joined(rows: pa.Table) -> pa.Table:
        ids: dict[int, bytes] = {}
        copies = 0
        for k, own in zip(rows["part"].to_pylist(), rows["ids"].to_pylist()):
            copies += k == 0
            ids[k] = own
        out = coder(name).folded([np.frombuffer(ids[k], "<u4") for k in sorted(ids)]).tobytes()
        return pa.table({"doc_id": rows["doc_id"][:1].combine_chunks().take([0] * copies), "ids": pa.array([out] * copies, pa.binary())})

    rows = docs.select("doc_id", "text")
    ids = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    keyed = [("doc_id", pa.int64()), ("key", pa.binary()), ("part", pa.int32())]
    short = per_document(rows.where(F.coalesce(F.length("text"), F.lit(0)) <= part), whole, ids, "doc_id long, ids binary")
    texts = per_document(rows.where(F.length("text") > part), parted, pa.schema([*keyed, ("text", pa.string())]), "doc_id long, key binary, part int, text string")
    parts = per_document(texts.repartition("key", "part"), encoded, pa.schema([*keyed, ("ids", pa.binary())]), "doc_id long, key binary, part int, ids binary")
    return short.unionByName(parts.groupBy("doc_id", "key").applyInArrow(joined, "doc_id long, ids binary"))


def decode(encoded: DataFrame, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): special tokens stay as their strings, ids that the vocabulary lacks give nothing; null ids are none."""

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        own = coder(name)
        for doc_id, ids in rows:
            yield doc_id, own.text(np.frombuffer(ids or b"", "<u4"))

    return per_document(encoded.select("doc_id", "ids"), kernel, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), "doc_id long, text string")


def _hashed(parts: Iterator[bytes]) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.hexdigest()


def digests(encoded: DataFrame, name: str = TOKENIZER, step: int = 1 << 16) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, ids): SHA-256 of the decimal ids joined by commas and of the decoded text, both made
    a stretch of ids at a time."""

    def decimals(own: Coder, ids: np.ndarray) -> Iterator[bytes]:
        for at in range(0, len(ids), step):
            yield ("," * (at > 0) + ",".join([own.decimal[i] if i < len(own.decimal) else str(i) for i in ids[at : at + step].tolist()])).encode()

    def texts(own: Coder, ids: np.ndarray) -> Iterator[bytes]:
        import codecs

        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), step):
            yield decoder.decode(own.raw(ids[at : at + step])).encode()
        yield decoder.decode(b"", True).encode()

    def kernel(rows: Iterator[tuple]) -> Iterator[tuple]:
        own: Coder = coder(name)
        for doc_id, raw in rows:
            ids = np.frombuffer(raw or b"", "<u4")
            yield doc_id, len(ids), _hashed(decimals(own, ids)), _hashed(texts(own, ids))

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return per_document(encoded.select("doc_id", "ids"), kernel, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable] = {"op11_bpe": op11_bpe}
#: A tokenizer has no SQL form; tests hold the ids against the tokenizers library and the text against its own decoding.
ORACLE_SQL: dict[str, str] = {}
