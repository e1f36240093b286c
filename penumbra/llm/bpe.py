"""Byte-pair encoding and decoding as a bounded-lookahead streaming transducer.

``Transducer.feed``/``finish`` take text in pieces and emit a token as soon as no later byte can
change it. Which tokens are stable follows from the merge list alone: :func:`sufficient_lookahead`
bounds how far right of a token's end a byte can still matter. Only the undecided tail is kept, so
the state of the encoder doesn't grow with the text. Decoding is the mirror image: bytes of tokens
enter an incremental UTF-8 state machine that holds at most three bytes.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ..session import ship_package

#: The published split pattern of this family of byte-level vocabularies.
PRETOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: What may follow within a pretoken of letters, numbers, white space, or anything else.
LETTERS, NUMBERS, WHITE, OTHERS = (regex.compile(c) for c in (r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*"))
CLASSES = (LETTERS, NUMBERS, WHITE, OTHERS)
#: Vocabularies larger than this are refused, as they travel to every executor.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pretokens remembered by each worker.
CACHE_ENTRIES = 400_000
#: Pretokens up to this many bytes are merged at once.
SHORT = 64


def byte_alphabet() -> dict[str, int]:
    """The published printable stand-ins for the 256 bytes: visible Latin-1 stands for itself, the rest follow from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes right of a token's end that can still change it, for any text.

    A merge at a boundary can be undone only by an earlier-ranked merge whose left part overlaps the
    end of the text seen so far; that one in turn depends only on merges ranked before it. The
    longest such chain of falling ranks, weighed by the bytes each link adds on the right, bounds
    the reach. Ranks are visited upwards, so one pass over the list finds the longest chain.
    """
    exact: dict[bytes, int] = {}  # left part -> longest reach of a merge that has it
    ends: dict[bytes, int] = {}  # the same, for every suffix of a left part
    longest = 0
    for left, right in merges:
        before = max([ends.get(right, 0), *(exact.get(right[k:], 0) for k in range(len(right)))])
        reach = len(right) + before
        longest = max(longest, reach)
        exact[left] = max(exact.get(left, 0), reach)
        for k in range(len(left)):
            ends[left[k:]] = max(ends.get(left[k:], 0), reach)
    return longest


class Merges:
    """A vocabulary with its merges, and the lookahead that they need."""

    def __init__(self, blob: str):
        spec = json.loads(blob)
        alphabet = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in vocabulary.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        ids = {t: i for i, t in self.bytes_of.items() if t.decode("utf-8", "replace") not in self.special}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        raw = [(bytes(alphabet[c] for c in a), bytes(alphabet[c] for c in b)) for a, b in pairs]
        self.single = [ids[bytes([b])] for b in range(256)]
        self.rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in reversed([*enumerate(raw)])}
        self.lookahead = sufficient_lookahead(raw)
        self.texts = {i: str(i) for i in self.bytes_of}
        self.splitter = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def merge_short(self, data: bytes) -> list[int]:
        """Apply the merges to a few bytes: the best-ranked, leftmost pair first."""
        single, rank = self.single, self.rank
        parts = [single[b] for b in data]
        while len(parts) > 1:
            best = None
            for k, pair in enumerate(zip(parts, parts[1:])):
                found = rank.get(pair)
                if found is not None and (best is None or found[0] < best[0]):
                    best = found
                    at = k
            if best is None:
                break
            parts[at : at + 2] = [best[1]]
        return parts

    def merge(self, data: bytes) -> list[int]:
        """As merge_short, with a heap of pairs over linked neighbours, for longer runs."""
        if len(data) <= SHORT:
            return self.merge_short(data)
        rank = self.rank
        token: list[int | None] = [self.single[b] for b in data]
        after = [*range(1, len(data)), -1]
        before = [*range(-1, len(data) - 1)]
        heap = [(*found, k, token[k], token[k + 1]) for k in range(len(data) - 1) if (found := rank.get((token[k], token[k + 1])))]
        heap = [(r, k, new, a, b) for r, new, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            n = after[k]
            if token[k] != a or n < 0 or token[n] != b:
                continue
            token[k], token[n] = new, None
            after[k] = m = after[n]
            if m >= 0:
                before[m] = k
                if found := rank.get((new, token[m])):
                    heapq.heappush(heap, (found[0], k, found[1], new, token[m]))
            if (p := before[k]) >= 0 and (found := rank.get((token[p], new))):
                heapq.heappush(heap, (found[0], p, found[1], token[p], new))
        return [t for t in token if t is not None]


class Run:
    """A pretoken of any length whose bytes come bit by bit; a window of four lookaheads is all it holds."""

    def __init__(self, merges: Merges, more):
        self.merges, self.more, self.held = merges, more, bytearray()
        self.window = max(4096, 4 * merges.lookahead)

    def push(self, data: bytes, out: list[int]) -> None:
        """Take bytes, and give the tokens that end a lookahead before the end of a full window."""
        self.held += data
        start = 0
        while len(self.held) - start > self.window:
            end = 0
            for t in self.merges.merge(bytes(self.held[start : start + self.window])):
                end += len(self.merges.bytes_of[t])
                if end > self.window - self.merges.lookahead:
                    end -= len(self.merges.bytes_of[t])
                    break
                out.append(t)
            start += end
        del self.held[:start]

    def close(self, out: list[int]) -> None:
        out += self.merges.merge(bytes(self.held))


class Transducer:
    """Streaming encoder of one text after another, with a bounded memory of frequent pretokens.

    What is kept between pieces: characters that may still be split or read otherwise, at most LONG of
    them and a special token's length, and the bytes of a longer pretoken that its Run holds.
    """

    #: Characters of a text that encode_documents feeds at once.
    PIECE = 1 << 16
    #: A pretoken that is longer than this before its end is known goes through a Run.
    LONG = 4096
    #: The split pattern decides where a pretoken ends by this many characters after it.
    AFTER = 2

    def __init__(self, merges: Merges):
        self.merges, self.known, self.tail, self.run = merges, {}, "", None
        self.longest = max(map(len, merges.special), default=0)

    def pretoken(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if len(data) <= SHORT:
            ids = tuple(self.merges.merge_short(data))
            if len(self.known) < CACHE_ENTRIES:
                self.known[piece] = ids
            return ids
        run, out = Run(self.merges, None), []
        run.push(data, out)
        run.close(out)
        return tuple(out)

    def _plain(self, text: str, at: int, end: int, closed: bool, out: list[int]) -> int:
        """Tokens of text[at:end], which has no special token. Unless it is closed, more may follow; returns where the undecided part begins."""
        if self.run:
            stop = self.run.more.match(text, at, end).end()
            over = stop < end or closed
            # The last white space of a run goes to what follows, if anything does.
            upto = stop - 1 if self.run.more is WHITE and (stop < end or not closed) else stop
            self.run.push(text[at:upto].encode(), out)
            at = upto
            if not over:
                return at
            self.run.close(out)
            self.run = None
        pieces = PRETOKEN.findall(text, at, end)  # every character is in one of them
        cut = end
        if not closed:
            while pieces and cut + self.AFTER > end:
                cut -= len(pieces.pop())
        known = self.known
        for piece in pieces:
            ids = known.get(piece)
            out += ids if ids is not None else self.pretoken(piece)
        if not closed and end - cut > self.LONG:
            first = text[cut + (text[cut] == " " and not text[cut + 1].isspace())]
            more = next(m for m in CLASSES if m.match(first).end())
            if more.match(text, cut + 1, end).end() == end:  # one pretoken so far
                self.run = Run(self.merges, more)
                upto = end - 1 if more is WHITE else end
                self.run.push(text[cut:upto].encode(), out)
                cut = upto
        return cut

    def _advance(self, text: str, final: bool) -> list[int]:
        out: list[int] = []
        at = 0
        special = self.merges.splitter
        sure = len(text) if final else max(0, len(text) - self.longest)  # a special token that begins up to here is whole
        while special and (m := special.search(text, at)) and (final or m.start() <= sure):
            self._plain(text, at, m.start(), True, out)
            out.append(self.merges.special[m[0]])
            at = m.end()
        at = self._plain(text, at, max(at, sure), final, out)
        self.tail = "" if final else text[at:]
        return out

    def feed(self, piece: str) -> list[int]:
        """Tokens that no later text can change, once ``piece`` is known; the rest waits."""
        return self._advance(self.tail + piece, False)

    def finish(self, piece: str = "") -> list[int]:
        """The remaining tokens, after a last piece. The transducer is then ready for another text."""
        return self._advance(self.tail + piece, True)

    def pieces(self, text: str | None, size: int | None = None) -> Iterator[list[int]]:
        """Token ids of a text as they become stable; null is the empty text. Special tokens' strings are single tokens."""
        text, size = text or "", size or self.PIECE
        at = 0
        while len(text) - at > size:
            yield self.feed(text[at : at + size])
            at += size
        yield self.finish(text[at:])

    def encode(self, text: str | None) -> list[int]:
        """All token ids of a text at once."""
        return [t for part in self.pieces(text) for t in part]


class Detokenizer:
    """Incremental byte-to-text state machine; malformed bytes become U+FFFD."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        text = self.machine.decode(b"", True)
        self.machine.reset()
        return text


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        blob = f.read()
    if len(blob) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to be sent to every executor")
    return blob


_WORKER: dict[int, Transducer] = {}


def worker_transducer(blob: str) -> Transducer:
    """One transducer for each Python worker and vocabulary, kept between batches and tasks."""
    key = hash(blob)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Transducer(Merges(blob))
    return _WORKER[key]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, digests: bool = True) -> DataFrame:
    """Encode and decode every whole text, row by row and piece by piece, without a shuffle.

    Tokens leave the transducer as they become stable and go on to the decoder and the running digests;
    only ``with_ids`` holds all ids of a text, as they are the result.

    Returns the id, n_tokens, and (by parameter) the ids, the SHA-256 of the comma-joined ids and
    that of the text decoded from them. A null text is an empty one: no tokens, digests of "".
    Repeated rows each get a row; null ids are kept; other columns are not read.
    """
    ship_package(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    fields = [pa.field("n_tokens", pa.int64())]
    schema = "n_tokens long"
    if with_ids:
        fields, schema = [*fields, pa.field("token_ids", pa.list_(pa.int32()))], schema + ", token_ids array<int>"
    if digests:
        fields, schema = [*fields, pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())], schema + ", ids_sha256 string, decoded_sha256 string"

    def run(batches):
        coder = worker_transducer(blob.value)
        back, texts = Detokenizer(coder.merges), coder.merges.texts
        for batch in batches:
            ids_column = batch.column(0)
            counts, lists, encoded, decoded = [], [], [], []
            for value in batch.column(1):
                n, ids_digest, text_digest = 0, hashlib.sha256(), hashlib.sha256()
                whole: list[int] = []
                for ids in coder.pieces(value.as_py()):
                    if digests and ids:
                        ids_digest.update(((n > 0) * "," + ",".join(map(texts.__getitem__, ids))).encode())
                        text_digest.update(back.feed(ids).encode())
                    n += len(ids)
                    if with_ids:
                        whole += ids
                counts.append(n)
                if with_ids:
                    lists.append(whole)
                if digests:
                    text_digest.update(back.finish().encode())
                    encoded.append(ids_digest.hexdigest())
                    decoded.append(text_digest.hexdigest())
            columns = [pa.array(counts, pa.int64())]
            columns += [pa.array(lists, pa.list_(pa.int32()))] * with_ids
            columns += [pa.array(encoded, pa.string()), pa.array(decoded, pa.string())] * digests
            yield pa.RecordBatch.from_arrays([ids_column, *columns], schema=pa.schema([pa.field("_id", ids_column.type), *fields]))

    id_type = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {id_type}, {schema}").withColumnRenamed("_id", id_col)
