"""Byte-level BPE as a bounded-lookahead transducer, and its incremental inverse."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tremolo.llm.base import MEMO, claim, tidy

#: Fixed values of the byte-level scheme: the split pattern, with white space as Unicode defines it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A place where a piece always ends, whatever stands before and after: behind a letter, a digit or
#: another sign where a character of another kind follows. A contraction can start only behind a cut.
SAFE_CUT = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\P{White_Space})(?=\p{White_Space})"
BLOCK_CHARS = 1 << 16
#: Characters of a piece that go to the transducer at a time, and of pieces that are remembered.
STREAM_CHARS, MEMO_CHARS = 1 << 12, 64
#: In place of a token: nothing stands left of the first one; no right tokenisation ends here; not asked yet.
START, NONE, UNKNOWN = -1, -2, -3
#: Positions after which the transducer looks back at least.
STEP = 128


def byte_letters() -> dict[str, int]:
    """Letter -> byte: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return out | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(raw[a], raw[b]): r for r, (a, b) in enumerate(merges)}
        self.parts = {raw[a] + raw[b]: (raw[a], raw[b]) for a, b in reversed(merges)}
        self.longest = max(map(len, self.ids))
        # A trie of the reversed tokens: node << 8 | byte -> node, and the id of the token that ends at a node.
        self.trie: dict[int, int] = {}
        self.ends = [-1]
        for t, i in self.ids.items():
            node = 0
            for x in reversed(t):
                node = self.trie.setdefault(node << 8 | x, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = i
        self.size = {i: len(t) for t, i in self.ids.items()}
        self.rank_of = {self.ids[x] << 20 | self.ids[y]: r for (x, y), r in self.ranks.items()}
        self.edges: tuple[dict, dict] = {}, {}
        self.single = [bytes([b]) for b in range(256)]
        self.id_text = {i: str(i).encode() for i in self.bytes_of}
        self.pieces = regex.compile(PIECES)
        self.find = self.pieces.findall
        self.cut = regex.compile(SAFE_CUT)
        self.by_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.lookahead = self.sufficient_lookahead()

    # The merge list

    def merge(self, piece: bytes) -> list[bytes]:
        """Applies the lowest-ranked merge, leftmost first, until none applies."""
        parts = [self.single[b] for b in piece]
        get, none = self.ranks.get, len(self.ranks)
        while len(parts) > 1:
            ranks = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == none:
                break
            out, i, n = [], 0, len(parts)
            while i < n:
                if i < n - 1 and ranks[i] == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def sufficient_lookahead(self) -> int:
        """Bytes to the right that can decide whether a merge happens.

        A merge (a, b) fails only if an earlier-ranked merge takes b, or the token on b's right edge
        that b is still to be made of, with what follows. That merge can fail in turn by one ranked
        earlier still, so the bound is the heaviest chain of falling ranks, found in rank order.
        """
        starts: dict[bytes, int] = {}  # token -> most bytes right of it that a merge which takes it first can need
        most = 0
        for (a, b), _ in sorted(self.ranks.items(), key=lambda x: x[1]):
            edge, reach = b, 0
            while True:
                reach = max(reach, starts.get(edge, 0))
                if edge not in self.parts:
                    break
                edge = self.parts[edge][1]
            need = len(b) + reach
            starts[a] = max(starts.get(a, 0), need)
            most = max(most, need)
        return most

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """What stands at an end of a token (0: left, 1: right) while it is made: (part, from rank, to rank)."""
        part, until, out = self.bytes_of[token], len(self.ranks), []
        while part in self.parts:
            made = self.ranks[self.parts[part]]
            out.append((self.ids[part], made, until))
            part, until = self.parts[part][side], made
        out.append((self.ids[part], -1, until))
        self.edges[side][token] = out
        return out

    def pair(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay two side by side; a sequence is right iff all its pairs are.

        They don't if, while both are made, some merge has a rank at which its two parts meet at the
        boundary. Of equal ranks the leftmost merge comes first.
        """
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        left, right = self.edges[1].get(a) or self._edge(a, 1), self.edges[0].get(b) or self._edge(b, 0)
        rank = self.rank_of.get
        for x, made, until in left:
            x <<= 20
            for y, made_y, until_y in right:
                r = rank(x | y)
                if r is not None and made < r < until and made_y < r <= until_y:
                    self.pairs[a << 20 | b] = False
                    return False
        self.pairs[a << 20 | b] = True
        return True

    def transduce(self, stream: Iterable[bytes], lookahead: int | None = None) -> Iterator[int]:
        """Token ids of one piece that comes in blocks, each emitted once nothing can change it.

        For each end position there is one last token that a right tokenisation can end with. A coming
        token can start at any of the last ``longest`` positions; what the ways to all of those have in
        common is stable. Memory is the unstable tail: ``lookahead`` bytes at least are awaited before
        the agreement is looked for.
        """
        wait = (self.lookahead if lookahead is None else lookahead) + self.longest
        tail, n = b"", 0
        last = [START]  # last[i]: the last token of tail[:i], NONE, or UNKNOWN as long as nobody asks
        before = START  # the last emitted token
        for block in stream:
            at, tail = len(tail), tail + block
            n = len(tail)
            last += [UNKNOWN] * (n - at)
            for i in range(at + STEP, n, STEP):
                self._ending(tail, last, i, before)
            if n >= wait:
                for i in range(n - self.longest, n + 1):
                    self._ending(tail, last, i, before)
                if cut := self._agreed(last, n):
                    yield from self._way(last, cut)
                    before = last[cut]
                    tail, last = tail[cut:], [START, *last[cut + 1 :]]
        self._ending(tail, last, len(tail), before)
        yield from self._way(last, len(tail))

    def _ending(self, tail: bytes, last: list[int], n: int, before: int) -> int:
        """Finds last[n]: of the tokens that end at n, longest first, one that may follow what is left of it.

        Positions further left are found as they are needed; STEP bounds how many calls stand on each other.
        """
        if last[n] != UNKNOWN:
            return last[n]
        trie, ends, pairs = self.trie.get, self.ends, self.pairs.get
        node, i, found = 0, n, []
        while i:
            i -= 1
            node = trie(node << 8 | tail[i])
            if node is None:
                break
            if ends[node] >= 0:
                found.append((i, ends[node]))
        for i, token in reversed(found):
            left = last[i]
            if left == UNKNOWN:
                left = self._ending(tail, last, i, before)
            if left == NONE:
                continue
            if left == START:
                left = before
            if left == START or (self.pair(left, token) if (ok := pairs(left << 20 | token)) is None else ok):
                last[n] = token
                return token
        last[n] = NONE
        return NONE

    def _way(self, last: list[int], i: int) -> list[int]:
        """The tokens that lead to position i."""
        out = []
        while i:
            out.append(last[i])
            i -= self.size[last[i]]
        return out[::-1]

    def _agreed(self, last: list[int], n: int) -> int:
        """The last position that the ways to all positions a coming token can start at have in common."""
        live = [-i for i in range(max(n - self.longest, 0), n + 1) if last[i] != NONE]
        heapq.heapify(live)
        while True:
            i = -heapq.heappop(live)
            while live and live[0] == -i:
                heapq.heappop(live)
            if not live or not i:
                return i
            heapq.heappush(live, self.size[last[i]] - i)

    # Texts

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece. Short ones are remembered, in two generations, so that frequent ones stay."""
        out = self.older.get(piece) or tuple(self.transduce((piece.encode("utf-8"),)))
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO // 2:
                self.older.clear()
                self.older.update(self.memo)
                self.memo.clear()
            self.memo[piece] = out
        return out

    def _block(self, text: str) -> list[int]:
        memo, out = self.memo, []
        for piece in self.find(text):
            out += memo.get(piece) or self.piece_ids(piece)
        return out

    def text_blocks(self, text: str) -> Iterator[list[int]]:
        """Ids of a text without special tokens, for some tens of thousands of characters at a time.

        A block ends at a safe cut; a piece that has none for longer than that streams through the
        transducer, so that no piece is ever held whole.
        """
        at, n = 0, len(text)
        while n - at > 2 * BLOCK_CHARS:
            if m := self.cut.search(text, at + BLOCK_CHARS, at + 2 * BLOCK_CHARS):
                yield self._block(text[at : m.start()])
                at = m.start()
                continue
            # The long piece may begin within the block: what is before it goes first.
            m = next(x for x in self.pieces.finditer(text, at) if x.end() >= at + BLOCK_CHARS)
            if m.start() > at:
                yield self._block(text[at : m.start()])
            stream = self.transduce(text[i : min(i + STREAM_CHARS, m.end())].encode("utf-8") for i in range(m.start(), m.end(), STREAM_CHARS))
            while ids := list(itertools.islice(stream, STREAM_CHARS)):
                yield ids
            at = m.end()
        yield self._block(text[at:] if at else text)

    def encode_blocks(self, text: str) -> Iterator[list[int]]:
        for part in self.by_special.split(text) if self.by_special and any(s in text for s in self.special) else (text,):
            if part in self.special:
                yield [self.special[part]]
            else:
                yield from self.text_blocks(part)

    def encode(self, text: str | None) -> list[int]:
        return [i for block in self.encode_blocks(text or "") for i in block]

    def decode_blocks(self, ids: Iterable[list[int]]) -> Iterator[str]:
        """Text of ids as they come: a byte that may still begin a character waits for the next."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for block in ids:
            yield state.decode(b"".join(map(self.bytes_of.__getitem__, block)))
        yield state.decode(b"", True)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_blocks([list(ids)]))


@lru_cache(2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _digests(model: ByteBpe, text: str | None) -> tuple[int, str, str]:
    of_ids, of_text, n = hashlib.sha256(), hashlib.sha256(), 0

    def seen():
        nonlocal n
        for block in model.encode_blocks(text or ""):
            if block:
                of_ids.update((b"," if n else b"") + b",".join(map(model.id_text.__getitem__, block)))
                n += len(block)
                yield block

    for out in model.decode_blocks(seen()):
        of_text.update(out.encode("utf-8"))
    return n, of_ids.hexdigest(), of_text.hexdigest()


def bpe_digests(docs: DataFrame, vocabulary: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key as doc_id, n_tokens, and SHA-256 of the ids and of the decoded text.

    A null or empty text has no tokens. Keys may repeat or be null; other columns are ignored, and
    an empty table gives an empty result. Beside the text itself, its ids and pieces are held for one
    block at a time, in any script.
    """

    def run(batches):
        model = load(vocabulary)
        claim(model.memo, model.older, model.pairs, forget=load.cache_clear)
        for batch in tidy(batches):
            rows = [_digests(model, x.as_py()) for x in batch.column(1)]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, vocabulary: str, *, text: str = "text", into: str = "ids") -> DataFrame:
    """All columns of docs and the ids of each text as array<int>; null and empty texts give []."""

    def run(batches):
        model = load(vocabulary)
        claim(model.memo, model.older, model.pairs, forget=load.cache_clear)
        for batch in tidy(batches):
            at = batch.schema.get_field_index(text)
            ids = pa.array([model.encode(x.as_py()) for x in batch.column(at)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, into])

    schema = T.StructType([f for f in docs.schema if f.name != into] + [T.StructField(into, T.ArrayType(T.IntegerType()))])
    return docs.drop(into).mapInArrow(run, schema)


def bpe_decode(docs: DataFrame, vocabulary: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns of docs and the text of each array of ids; null and empty arrays give ''."""
    def run(batches):
        model = load(vocabulary)
        claim(model.memo, model.older, model.pairs, forget=load.cache_clear)
        for batch in tidy(batches):
            at = batch.schema.get_field_index(ids)
            out = pa.array([model.decode(x.as_py() or []) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, into])

    schema = T.StructType([f for f in docs.schema if f.name != into] + [T.StructField(into, T.StringType())])
    return docs.drop(into).mapInArrow(run, schema)
