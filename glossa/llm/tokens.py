"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

``encode_corpus`` replays the vocabulary's merges over a slice of the corpus at
once instead of word by word: the distinct pre-tokens of a slice are laid out
in one linked array of symbols, an inverted index leads from each pair of
neighbouring symbols to its positions, and a heap hands out the pairs that
occur in rank order. Applying a merge touches only the two neighbours of every
position it changes. Each distinct pre-token is therefore merged once per
slice, however often the slice repeats it, and no row leaves its partition:
the plan is a scan and one Arrow stage, without a shuffle.

The vocabulary file is read on the driver and shipped as a Spark broadcast; its
size is that of a fixed public file (about 1.5 MB).
"""

from __future__ import annotations

import heapq
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glossa.runtime import spread

TOKENIZER_DIR = "/opt/tokenizers"

# Fixed value: the split that byte-level BPE vocabularies of this family apply
# before their merges.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Code points of text replayed at once, and pre-tokens kept from earlier slices.
SLICE_CHARS = 4_000_000
MEMO_WORDS = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    spare = iter(range(256, 512))
    for b in range(256):
        if b not in letters:
            letters[b] = chr(next(spare))
    return [letters[b] for b in range(256)]


def load_vocabulary(path: str) -> tuple[np.ndarray, dict[int, tuple[int, int]]]:
    """(id of each byte, {pair key: (rank, merged id)}) of a tokenizer JSON file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    of_byte = np.array([vocab[c] for c in byte_letters()], np.int32)
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges[vocab[a] << 20 | vocab[b]] = (rank, vocab[a + b])
    return of_byte, merges


def replay(words: list[bytes], of_byte: np.ndarray, merges: dict[int, tuple[int, int]]) -> list[list[int]]:
    """The token ids of each word, by one replay of the merges over all of them."""
    if not words:
        return []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1)
    flat = np.full(int(ends[-1]), -1, np.int64)
    raw = of_byte[np.frombuffer(b"".join(words), np.uint8)]
    inside = np.ones(len(flat), bool)
    inside[ends - 1] = False
    flat[inside] = raw
    n = len(flat)
    keys = np.where((flat[:-1] >= 0) & (flat[1:] >= 0), flat[:-1] << 20 | flat[1:], -1)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if n > 1 else np.array([], int)
    bounds = np.r_[starts, len(sorted_keys)]
    index: dict[int, list[int]] = {}
    heap: list[tuple[int, int]] = []
    for i, s in enumerate(starts):
        k = int(sorted_keys[s])
        hit = merges.get(k) if k >= 0 else None
        if hit is not None:
            index[k] = order[s : bounds[i + 1]].tolist()
            heap.append((hit[0], k))
    heapq.heapify(heap)
    sym = flat.tolist()
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    while heap:
        _, key = heapq.heappop(heap)
        places = index.pop(key, None)
        if places is None:
            continue
        a, b, new = key >> 20, key & 0xFFFFF, merges[key][1]
        places.sort()
        for p in places:
            q = nxt[p] if sym[p] == a else n
            if q >= n or sym[q] != b:
                continue  # an earlier merge took one of the two
            sym[p] = new
            sym[q] = -2
            r = nxt[q]
            nxt[p] = r
            if r < n:
                prv[r] = p
                if (s := sym[r]) >= 0 and (hit := merges.get(k := new << 20 | s)) is not None:
                    if k not in index:
                        index[k] = []
                        heapq.heappush(heap, (hit[0], k))
                    index[k].append(p)
            o = prv[p]
            if o >= 0 and (s := sym[o]) >= 0 and (hit := merges.get(k := s << 20 | new)) is not None:
                if k not in index:
                    index[k] = []
                    heapq.heappush(heap, (hit[0], k))
                index[k].append(o)
    left = np.array(sym, np.int64)
    word_of = np.repeat(np.arange(len(words)), sizes + 1)
    keep = left >= 0
    ids, owner = left[keep], word_of[keep]
    cuts = np.searchsorted(owner, np.arange(1, len(words)))
    ids = ids.tolist()
    edges = [0, *cuts.tolist(), len(ids)]
    return [ids[i:j] for i, j in zip(edges, edges[1:])]


class Encoder:
    """Encodes batches of texts; remembers the pre-tokens of earlier slices."""

    def __init__(self, of_byte: np.ndarray, merges: dict[int, tuple[int, int]]):
        self.of_byte, self.merges = of_byte, merges
        self.memo: dict[str, list[int]] = {}
        self.split = regex.compile(PRETOKEN).findall

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        out: list[list[int]] = []
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j] or "") <= SLICE_CHARS):
                chars += len(texts[j] or "")
                j += 1
            out += self._slice(texts[i:j])
            i = j
        return out

    def _slice(self, texts: list[str | None]) -> list[list[int]]:
        parts = [self.split(t) if t else [] for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        fresh = list(set(chain.from_iterable(parts)).difference(self.memo))
        for w, ids in zip(fresh, replay([w.encode("utf-8", "surrogatepass") for w in fresh], self.of_byte, self.merges)):
            self.memo[w] = ids
        get = self.memo.__getitem__
        return [list(chain.from_iterable(map(get, p))) for p in parts]


def encode_corpus(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k",
    tokenizer_dir: str = TOKENIZER_DIR,
) -> DataFrame:
    """``(id_col, ids)``: the token ids of every document, without special tokens.

    Defined cases: null and empty texts give an empty list; strings that look
    like special tokens are ordinary text; a repeated row gives a repeated row;
    a null id is kept; an empty table gives an empty table; other columns, also
    one called ``ids``, are ignored.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(load_vocabulary(os.path.join(tokenizer_dir, f"{tokenizer}.json")))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        coder = Encoder(*shipped.value)
        for batch in batches:
            coded = coder.encode(batch.column(1).to_pylist())
            offsets = np.zeros(len(coded) + 1, np.int32)
            np.cumsum([len(c) for c in coded], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(coded), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, schema)
