"""Best-fit packing of token sequences by the sum-of-squares rule.

Nulls and empty texts are the single end id. Rows without an id are packed like others. Only documents longer than a sequence are cut. Repeated rows
are packed each on its own; an empty table packs to nothing. Ties in length go by id and piece. Very long texts are
encoded whole, their words looked up in batches.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain
from unicodedata import normalize

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import batches, doc_text, scan, written

PIECES = "doc_id long, piece int, start long, length long, ids binary"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class WordCoder:
    """Ids of words that hold no ASCII white space, exactly as the tokenizer gives them.

    A word of letters with dots and commas behind it is what most words are: its letters and its marks
    are separate words to the tokenizer's splitter, so the letters are looked up in lower case, and new
    ones go to the same merge table without normaliser and splitter. Any other word takes the whole tokenizer.
    """

    def __init__(self, spec: str, most: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.most = Tokenizer.from_str(spec), most
        if getattr(self.whole.model, "end_of_word_suffix", None) != "</w>" or "lowercase" not in str(self.whole.normalizer).lower():  # what looking words up by their letters rests on
            raise ValueError("the tokenizer must lower-case its text and end words with </w>")
        self.bare = Tokenizer(self.whole.model)  # the same merge table, not a second one
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.bare.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        shown = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        hidden = [b for b in range(256) if b not in shown]
        self.shown = shown | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.cores: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _learn(self, cores: list[str]) -> None:
        import numpy as np

        for i in range(0, len(cores), 6400):
            part = cores[i : i + 6400]
            lines = [" ".join(c.encode().decode("latin-1").translate(self.shown) for c in part[j : j + 64]) for j in range(0, len(part), 64)]
            ids = np.fromiter(chain.from_iterable(x.ids for x in self.bare.encode_batch_fast(lines, add_special_tokens=False)), "<u4")
            raw, bounds = ids.tobytes(), [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            self.cores.update(zip(part, (raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)), strict=True))

    def __call__(self, words: list[str]):
        """Number of ids of each word, and all ids in a row."""
        import numpy as np

        if len(self.cores) > self.most:
            self.cores = {}
        cut: list[tuple[str, str] | None] = []
        for w in words:
            c = w.rstrip(".,")
            low = c.lower()
            cut.append((low, w[len(c) :]) if low.isalpha() and "Σ" not in c and (low.isascii() or normalize("NFC", c) == c) else None)
        self._learn(list({x[0] for x in cut if x and x[0] not in self.cores}))
        # in lots, as what the tokenizer returns of a word is far larger than its ids
        plain = lambda ws: [np.array(e.ids, "<u4").tobytes() for i in range(0, len(ws), 1024) for e in self.whole.encode_batch_fast(ws[i : i + 1024], add_special_tokens=False)]
        odd = [w for w, x in zip(words, cut, strict=True) if x is None]
        rest = iter(plain(odd)) if odd else iter(())
        marks = sorted({x[1] for x in cut if x} - self.marks.keys())
        self.marks.update(zip(marks, plain(marks) if marks else [], strict=True))
        ids = [self.cores[x[0]] + self.marks[x[1]] if x else next(rest) for x in cut]
        return np.array([len(x) // 4 for x in ids], np.int64), np.frombuffer(b"".join(ids), "<u4")


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, cached_words: int = 1 << 19, batch_bytes: int = 8 << 20) -> DataFrame:
    """Pieces of at most ``size`` ids; ``ids``: little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never joins over it, so words are encoded once and looked up after.
    ``cached_words`` and ``batch_bytes`` bound what a task holds; they don't change what it returns.
    """
    import public_tokenizers

    path = tokenizer if os.path.exists(tokenizer) else public_tokenizers.path(tokenizer)
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = end_id.to_bytes(4, "little")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = WordCoder(spec.value, cached_words)
        for part, texts in batches(parts, batch_bytes):
            lists = pc.ascii_split_whitespace(pa.array([t or b"" for t in texts], pa.binary()).cast(pa.string()))
            coded = lists.flatten().dictionary_encode()
            size_of, ids_of = coder(coded.dictionary.to_pylist())
            # a document's ids are those of its words, one after another, then the end id
            word = coded.indices.to_numpy()
            first = np.concatenate(([0], np.cumsum(size_of)))[word]
            n = size_of[word]
            at = np.concatenate(([0], np.cumsum(n)))
            ids = ids_of[np.repeat(first - at[:-1], n) + np.arange(at[-1])]
            bounds = at[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
            out = []
            for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                raw = ids[a:b].tobytes() + end
                out += [(doc, k, k * size, raw[j : j + 4 * size]) for k, j in enumerate(range(0, len(raw), 4 * size))]
            doc, piece, start, raw = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return doc_text(docs).mapInArrow(run, PIECES)


def sum_of_squares(lengths: list[int], size: int, frugal: bool = True) -> list[tuple[int, int]]:
    """Bin and offset of each length, in the order given.

    An item goes where the sum of squared counts of open bins per residual gap becomes smallest; among
    equals, to the smallest gap. ``frugal``: a bin is opened only for what fits in no open one, as suits
    lengths that are all known beforehand; else a new bin competes like the rest, and loses ties.
    """
    import numpy as np

    count = np.zeros(size + 1, np.int64)  # open bins by gap; a full bin isn't open
    bins: list[list[int]] = [[] for _ in range(size + 1)]
    out, made = [], 0
    far = np.iinfo(np.int64).max
    for s in lengths:
        rest = count[: size + 1 - s] * 2 + 1
        rest[0] = 0
        cost = np.where(count[s:] > 0, rest - 2 * count[s:] + 1, far)
        cost[size - s] = far  # that gap is a new bin's
        g = s + int(cost.argmin())
        new = 2 * count[size - s] + 1 if s < size else 0
        if cost[g - s] != far and (frugal or cost[g - s] <= new):
            b = bins[g].pop()
            count[g] -= 1
        else:
            b, g, made = made, size, made + 1
        out.append((b, size - g))
        if g > s:
            bins[g - s].append(b)
            count[g - s] += 1
    return out


def pack(pieces: DataFrame, size: int = 2048, shard: int = 16384) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Pieces are dealt by a hash of the row, its place in the table included, to shards of about ``shard`` rows, however many
    there are and whatever their ids, and each shard is packed in one task, longest first; what a shard leaves open at its end is under one part in a hundred.
    """
    n = max(1, -(-pieces.count() // shard))

    def run(key, x):
        x = x.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        placed = sum_of_squares(x["length"].tolist(), size)
        x["sequence_id"] = [(key[0] << 32) + b for b, _ in placed]
        x["offset"] = [o for _, o in placed]
        return x[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(n))).groupBy("shard").applyInPandas(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", size: int = 2048, **bounds: int) -> DataFrame:
    pieces = token_pieces(docs, tokenizer, size, **bounds).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(written(pieces), size)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(scan(spark, sf_dir, "documents"))
