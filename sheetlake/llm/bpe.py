"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

Merges are applied by rank.  Take two inputs with a common prefix and run the merges on both rule by
rule: the part in which they agree ends at the prefix's end and shrinks by ``len(u)`` only when a rule
``(u, v)`` merges the last agreed token u with a v that is there in one input alone.  The next rule that
shrinks it has a larger rank and a right part that was grown, leftmost first, from that u.  The longest
such chain of rules, summed over the lengths of their left parts, is a lookahead that suffices: a token
that ends so many bytes before the end of what was read can't change any more and is emitted.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sheetlake.llm.tables import arrow_map

#: Fixed value: how the byte-level pre-tokenizer cuts a text.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", regex.V0
)
#: The same for texts of ASCII characters alone, where Python's own matcher knows the classes.
ASCII_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII
)
#: Characters looked at together while a text is cut; the last matches are cut again with what follows.
CHUNK, UNSURE = 1 << 16, 3
#: Bytes that remembered pieces may take in a worker, about what one takes besides its text, and the longest remembered.
REMEMBERED, EACH, SHORT = 32 << 20, 90, 48
#: Rank of a pair that is no merge.
NEVER = 1 << 62
#: Largest vocabulary file that is sent to the executors.
MAX_VOCAB_BYTES = 64 << 20


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else the next above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Asked(dict):
    """A dict that calls ``find`` for a key it does not have; so it can be mapped over keys without a loop."""

    def __init__(self, find: Callable, *known):
        super().__init__(*known)
        self.find = find

    def __missing__(self, key) -> bytes:
        return self.find(key)


class ByteBPE:
    """A byte-level BPE vocabulary in the layout of the tokenizers library's JSON files."""

    def __init__(self, source: str):
        stated = json.loads(source)
        model = stated["model"]
        alphabet = byte_alphabet()
        self.specials = {t["content"]: t["id"] for t in stated.get("added_tokens", [])}
        self.bytes_of = {
            i: bytes(alphabet[c] for c in token) for token, i in model["vocab"].items()
        } | {i: text.encode() for text, i in self.specials.items()}
        self.said = Asked(lambda _: b"", self.bytes_of)
        self.single = [0] * 256
        for i, raw in self.bytes_of.items():
            if len(raw) == 1:
                self.single[raw[0]] = i
        vocab = model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.made.append(vocab[left + right])
            self.merges[vocab[left], vocab[right]] = rank, vocab[left + right]
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.lookahead = self._lookahead()
        self.split_specials = (
            regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))
            if self.specials else None
        )
        self.known = Asked(self._find)
        self.taken = 0

    def forget(self) -> None:
        """Drop all remembered pieces."""
        self.known.clear()
        self.taken = 0

    def _lookahead(self) -> int:
        """The longest reach of a change to the left, in bytes."""
        made: dict[int, tuple[int, int]] = {}
        used: set[int] = set()
        reach: dict[int, int] = {}
        longest = 0
        for (left, right), (_, token) in sorted(self.merges.items(), key=lambda m: m[1][0]):
            used |= {left, right}
            if token in made or token in used:
                raise ValueError("a merge uses a token that a later merge makes, or makes one again")
            made[token] = left, right
            best, part = 0, right
            while True:
                best = max(best, reach.get(part, 0))
                if part not in made:
                    break
                part = made[part][0]
            own = len(self.bytes_of[left]) + best
            longest = max(longest, own)
            reach[left] = max(reach.get(left, 0), own)
        return longest

    def merged(self, data: bytes) -> list[int]:
        """All merges applied to the bytes, lowest rank first, leftmost first."""
        ids = [self.single[b] for b in data]
        n = len(ids)
        if n <= SHORT:
            get, made = self.ranks.get, self.made
            ranks = [get(pair, NEVER) for pair in zip(ids, ids[1:])]  # noqa: B905
            while ranks and (best := min(ranks)) != NEVER:
                i = ranks.index(best)
                ids[i : i + 2] = [made[best]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = get((ids[i], ids[i + 1]), NEVER)
                if i:
                    ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            return ids
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found[0], i) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = merges.get((ids[i], ids[j]))
            if not found or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((ids[i], ids[k])):
                    heapq.heappush(queue, (found[0], i))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], ids[i]))):
                heapq.heappush(queue, (found[0], h))
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> bytes:
        """Packed ids of one piece; short pieces are remembered, up to a bound."""
        return self.known[text]

    def _find(self, text: str) -> bytes:
        data = text.encode()
        if len(data) > self.lookahead:
            transducer = Transducer(self)
            return b"".join(map(pack, chain(transducer.feed(data), transducer.finish())))
        found = array("I", self.merged(data)).tobytes()
        if len(data) <= SHORT:
            self.taken += EACH + len(data) + len(found)
            if self.taken > REMEMBERED:
                self.forget()
            self.known[text] = found
        return found

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids of a text, part by part; strings of special tokens are those tokens."""
        at = 0
        for m in self.split_specials.finditer(text) if self.split_specials else ():
            yield from self._plain(text, at, m.start())
            yield pack(self.specials[m.group()])
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, at: int, end: int) -> Iterator[bytes]:
        packed, size = self.known.__getitem__, CHUNK
        text = text[at:end] if at or end < len(text) else text
        at, end = 0, end - at
        cut = (ASCII_PIECES if text.isascii() else PIECES).findall
        while at < end:
            stop = min(at + size, end)
            found = cut(text, at, stop)
            if stop < end:
                if len(found) <= UNSURE:
                    size *= 2
                    continue
                del found[-UNSURE:]
            at += sum(map(len, found))
            size = CHUNK
            yield b"".join(map(packed, found))


def pack(token: int) -> bytes:
    return token.to_bytes(4, "little")


class Transducer:
    """Takes bytes of one piece, emits token ids as soon as they are stable."""

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.kept = bpe, b""

    def feed(self, data: bytes) -> Iterator[int]:
        step = max(self.bpe.lookahead, 4096)
        for at in range(0, len(data), step):
            self.kept += data[at : at + step]
            if len(self.kept) < self.bpe.lookahead + step:
                continue
            ended, stable = 0, len(self.kept) - self.bpe.lookahead
            for token in self.bpe.merged(self.kept):
                if ended + len(self.bpe.bytes_of[token]) > stable:
                    break
                ended += len(self.bpe.bytes_of[token])
                yield token
            self.kept = self.kept[ended:]

    def finish(self) -> Iterator[int]:
        yield from self.bpe.merged(self.kept)
        self.kept = b""


class Decoder:
    """Takes token ids, gives text; holds back the bytes of an unfinished character only."""

    def __init__(self, bpe: ByteBPE):
        self.said = bpe.said.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, tokens: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.said, tokens)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def _loaded(source: str) -> ByteBPE:
    return ByteBPE(source)


def _vocabulary(frame: DataFrame, path: str):
    """The vocabulary file as a broadcast, so that only the driver needs the path."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    if len(source) > MAX_VOCAB_BYTES:
        raise ValueError(f"vocabulary file of more than {MAX_VOCAB_BYTES} bytes")
    return frame.sparkSession.sparkContext.broadcast(source)


def encode_texts(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id and ``ids``, the token ids of the whole text as little-endian unsigned 32-bit integers.

    Equal to the tokenizers library's encoding without added special tokens; strings of special tokens
    in a text become those tokens.  Null text counts as empty and has no ids.  Repeated rows and null
    doc_ids come back as they are, an empty table gives no rows, other columns are ignored.
    """
    source = _vocabulary(docs, vocab_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(source.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [b"".join(bpe.encode(t.as_py() or "")) for t in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return arrow_map(docs.select("doc_id", "text"), encode, "doc_id long, ids binary")


def decode_ids(tokens: DataFrame, vocab_path: str) -> DataFrame:
    """``tokens`` (doc_id, ids) with ``text``: the ids decoded, special tokens kept.

    Bytes that are no UTF-8 become U+FFFD; ids outside the vocabulary are skipped; null ids give empty
    text.
    """
    source = _vocabulary(tokens, vocab_path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(source.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for raw in part.column(1):
                    machine, view = Decoder(bpe), iter(memoryview(raw.as_py() or b"").cast("I"))
                    pieces = []
                    while group := list(islice(view, 8192)):
                        pieces.append(machine.feed(group))
                    texts.append("".join(pieces) + machine.finish())
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"]
                )

    return arrow_map(tokens.select("doc_id", "ids"), decode, "doc_id long, ids binary, text string")


def digest_tokens(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Number and digest of each text's tokens, and the digest of the text they decode to.

    One pass: tokens go to the decoder and both digests as they come, so a text takes no memory but its
    own.  Null text is empty; repeated rows and null doc_ids come back as they are; an empty table gives
    no rows.
    """
    source = _vocabulary(docs, vocab_path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(source.value)
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            for text in batch.column(1):
                machine, ids, said, n = Decoder(bpe), hashlib.sha256(), hashlib.sha256(), 0
                for part in bpe.encode(text.as_py() or ""):
                    ids.update(part)
                    n += len(part) // 4
                    view = memoryview(part).cast("I")
                    for at in range(0, len(view), 8192):
                        said.update(machine.feed(view[at : at + 8192]).encode())
                said.update(machine.finish().encode())
                rows.append((n, ids.hexdigest(), said.hexdigest()))
            counts, shas, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(docs.select("doc_id", "text"), digest, schema)
