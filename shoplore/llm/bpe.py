"""Byte-level BPE by contiguous rank arrays: the parts of a short word and the ranks of neighbouring parts
lie side by side; the smallest rank is found by a scan, its boundary deleted, and the ranks next to it
looked up again. Words of one length are worked on together, a step of all of them at a time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplore.llm.common import per_text, send_package

#: Words of up to so many bytes are merged by scanning; longer ones through a heap, with the same result.
SHORT = 48
#: A worker forgets its words when they take so many bytes, about; they are then merged again.
REMEMBERED = 48 << 20
#: What an entry takes besides its word and ids.
_ENTRY = 160
#: Longer texts are cut between two words, where no token can cross.
SEGMENT = 1 << 20

# Fixed value: how byte-level tokenizers of this kind cut a text into words.
WORD_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

_NONE = 1 << 30


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the other bytes take the code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder made from the JSON of a byte-level BPE tokenizer.

    Needs a ByteLevel pre-tokenizer without a prefix space, no normalizer, no dropout, and added
    tokens that are matched as they stand. Anything else is refused.
    """

    def __init__(self, definition: str):
        import numpy as np
        import regex

        whole = json.loads(definition)
        model, pre = whole["model"], whole["pre_tokenizer"] or {}
        if (model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or whole["normalizer"] or model.get("dropout") or model.get("ignore_merges")):
            raise ValueError("not a plain byte-level BPE tokenizer")
        added = whole["added_tokens"]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("added tokens with conditions are not supported")
        vocab = model["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.pieces = {i: bytes(map(byte_of.__getitem__, token)) for token, i in vocab.items()}
        self.added = {a["content"]: a["id"] for a in added}
        self.pieces |= {i: token.encode() for token, i in self.added.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = np.array([a << 32 | b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in self.merges.values()], dtype=np.int64)[order]
        self.results = np.array([new for _, new in self.merges.values()], dtype=np.int64)
        self.results_by_rank = self.results[np.argsort([r for r, _ in self.merges.values()])]
        self.words = regex.compile(WORD_PATTERN)
        self.cut = regex.compile(r"(?<=\p{L}) (?=\p{L})")
        self.specials = regex.compile("(" + "|".join(
            map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def _rank(self, left, right):
        """Ranks of pairs of parts; ``_NONE`` where they do not merge."""
        import numpy as np

        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)

    def _merge_short(self, words: list[bytes], length: int) -> Iterator[bytes]:
        """Ids of words that are all ``length`` bytes long, as little-endian 32-bit integers."""
        import numpy as np

        raw = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(-1, length)
        parts = self.byte_ids[raw]
        ranks = np.full(parts.shape, _NONE, dtype=np.int64)
        ranks[:, :-1] = self._rank(parts[:, :-1], parts[:, 1:])
        size = np.full(len(words), length)
        rows, columns = np.arange(len(words)), np.arange(length)
        while len(rows):
            at = ranks[rows].argmin(axis=1)
            best = ranks[rows, at]
            live = best < _NONE
            rows, at, best = rows[live], at[live], best[live]
            if not len(rows):
                break
            size[rows] -= 1
            # delete the boundary after ``at``: what lies behind moves up by one
            source = np.minimum(columns + (columns > at[:, None]), length - 1)
            moved = np.take_along_axis(parts[rows], source, axis=1)
            near = np.take_along_axis(ranks[rows], np.minimum(columns + (columns >= at[:, None]), length - 1), axis=1)
            near[:, -1] = _NONE
            here = np.arange(len(rows))
            moved[here, at] = self.results_by_rank[best]
            # refresh the ranks on both sides
            right = np.minimum(at + 1, length - 1)
            near[here, at] = np.where(at + 1 < size[rows], self._rank(moved[here, at], moved[here, right]), _NONE)
            left = np.maximum(at - 1, 0)
            near[here, left] = np.where(at > 0, self._rank(moved[here, left], moved[here, at]), near[here, left])
            parts[rows], ranks[rows] = moved, near
        blob, step = parts.astype("<u4").tobytes(), 4 * length
        for begun, n in zip(range(0, len(blob), step), size.tolist()):
            yield blob[begun:begun + 4 * n]

    def _merge_long(self, word: bytes) -> bytes:
        """The same merges for a word of any length: candidates wait in a heap by rank and place."""
        import numpy as np

        ids = self.byte_ids[np.frombuffer(word, dtype=np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        before = list(range(-1, len(ids) - 1))

        def push(i):
            j = after[i]
            if j >= 0 and (found := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (found[0], i, ids[i], ids[j], found[1]))

        heap: list = []
        for i in range(len(ids) - 1):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def _learn(self, words: Iterable[str]) -> None:
        """Merge the words that are not known yet."""
        by_length: dict[int, list] = {}
        for word in words:
            raw = word.encode()
            self.known_bytes += _ENTRY + 3 * len(raw)
            by_length.setdefault(len(raw), []).append((word, raw))
        for length, group in by_length.items():
            if length <= SHORT:
                for at in range(0, len(group), 4096):
                    part = group[at:at + 4096]
                    merged = self._merge_short([raw for _, raw in part], length)
                    self.known.update(zip((word for word, _ in part), merged))
            else:
                self.known.update((word, self._merge_long(raw)) for word, raw in group)

    def _segments(self, text: str) -> Iterator[str]:
        begun = 0
        while len(text) - begun > SEGMENT and (found := self.cut.search(text, begun + SEGMENT)):
            yield text[begun:found.start()]
            begun = found.start()
        yield text[begun:] if begun else text

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a null text is empty."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str] | bytes]] = []
        held = 0

        def settle():
            nonlocal held
            if self.known_bytes > REMEMBERED:
                self.known.clear()
                self.known_bytes = 0
            words = set(chain.from_iterable(w for _, w in waiting if isinstance(w, list)))
            self._learn(word for word in words if word not in self.known)
            for i, w in waiting:
                out[i].append(b"".join(map(self.known.__getitem__, w)) if isinstance(w, list) else w)
            waiting.clear()
            held = 0

        for i, text in enumerate(texts):
            for part in (self.specials.split(text) if self.specials and text else [text]):
                if not part:
                    continue
                if part in self.added:
                    waiting.append((i, self.added[part].to_bytes(4, "little")))
                    continue
                for segment in self._segments(part):
                    waiting.append((i, self.words.findall(segment)))
                    held += len(segment)
                    if held > SEGMENT:
                        settle()
        settle()
        return [b"".join(x) for x in out]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; ids that are not in the vocabulary give nothing, broken UTF-8 gives U+FFFD."""
        return b"".join(self.pieces.get(i, b"") for i in ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: bytes) -> str:
        import numpy as np

        wanted = np.frombuffer(ids, dtype="<u4").tolist()
        try:
            raw = b"".join(map(self.pieces.__getitem__, wanted))
        except KeyError:
            return self.decode(wanted)
        return raw.decode("utf-8", "replace")


_CODERS: dict[str, ByteBpe] = {}


def _coder(shared: Broadcast) -> ByteBpe:
    """One coder per worker and vocabulary; it outlives the task, as do the words it knows."""
    digest, definition = shared.value
    if digest not in _CODERS:
        _CODERS.clear()
        _CODERS[digest] = ByteBpe(definition)
    return _CODERS[digest]


def load_tokenizer(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> Broadcast:
    """Read a tokenizer file on the driver and send it to the executors, who may not have it.

    A vocabulary is a file of fixed size, whatever the size of the corpus; one over ``most_bytes``
    is refused.
    """
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    if len(definition) > most_bytes:
        raise ValueError(f"{path} has over {most_bytes} bytes")
    ByteBpe(definition)  # refuse what can't be encoded before a job starts
    return spark.sparkContext.broadcast((hashlib.sha256(definition.encode()).hexdigest(), definition))


def bpe_encode(df: DataFrame, tokenizer: Broadcast, key: str = "doc_id", text: str = "text",
               ids: str = "ids") -> DataFrame:
    """``key``, ``n_tokens`` and the token ids of each row, without a shuffle.

    A null or empty text has no tokens. Rows are encoded by themselves, so repeated rows and null
    keys give a row each; columns other than the two named are not read.
    """
    def make():
        coder = _coder(tokenizer)

        def work(texts):
            import numpy as np

            found = coder.encode(texts)
            return [[len(x) // 4 for x in found], [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in found]]

        return work

    return per_text(df, key, text, [T.StructField("n_tokens", T.LongType()),
                                    T.StructField(ids, T.ArrayType(T.IntegerType(), False))], make)


def bpe_decode(df: DataFrame, tokenizer: Broadcast, ids: str = "ids", out: str = "text") -> DataFrame:
    """The rows of ``df`` with the text of their ids; null ids give a null text."""
    @F.pandas_udf(T.StringType())
    def decoded(column):
        coder = _coder(tokenizer)
        return column.map(lambda x: None if x is None else coder.decode(x.tolist() if hasattr(x, "tolist") else x))

    send_package(df.sparkSession)
    return df.withColumn(out, decoded(F.col(ids)))


def bpe_digest(df: DataFrame, tokenizer: Broadcast, key: str = "doc_id", text: str = "text",
               ids: str | None = None) -> DataFrame:
    """``key``, ``n_tokens``, and SHA-256 of the ids and of the text decoded from them.

    Encodes and decodes like :func:`bpe_encode` and :func:`bpe_decode`; the ids leave the worker only
    if ``ids`` names a column for them.
    """
    def make():
        coder = _coder(tokenizer)

        def work(texts):
            import numpy as np

            found = coder.encode(texts)
            sha = hashlib.sha256
            out = [[len(x) // 4 for x in found], [sha(x).hexdigest() for x in found],
                   [sha(coder.decode_bytes(x).encode()).hexdigest() for x in found]]
            return out + ([[np.frombuffer(x, dtype="<u4").astype(np.int32) for x in found]] if ids else [])

        return work

    return per_text(df, key, text, [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
        *([T.StructField(ids, T.ArrayType(T.IntegerType(), False))] if ids else [])], make)
