"""Token counts by overlap resynchronisation.

A text up to ``chunk`` characters is encoded whole.  A longer one is cut into chunks that overlap by ``overlap``
characters on either side of each border; the chunks are dealt over the cluster, each is encoded with character
offsets, and neighbours are spliced at a boundary that both encodings have and that is *stable*: no piece of the
vocabulary holds the two characters around it side by side, so no merge can ever cross it and the tokens on
either side do not depend on each other.  Where no such boundary lies in the overlap, the text goes into the next
round with overlaps eight times as wide, at last whole.

Nulls count as empty (0 bytes, 0 tokens); repeated rows are counted row by row; an empty table gives no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import column, documents, raw, saved

MODEL = "piece_bpe_32k.model"
CHUNK = 32_768
OVERLAP = 256
LIMIT = 4096


@lru_cache(maxsize=4)
def tokenizer(model: str):
    """The tokenizer, the characters each id stands for, and the character pairs inside pieces."""
    import public_tokenizers
    import sentencepiece

    path = model if "/" in model else public_tokenizers.path(model)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    size = np.zeros(sp.get_piece_size(), np.int64)
    pairs = set()
    for i in range(len(size)):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            size[i] = (int(piece[3:5], 16) & 0xC0) != 0x80
        else:
            size[i] = len(piece)
            pairs.update(piece[j:j + 2] for j in range(len(piece) - 1))
    return sp, size, pairs


def encode(sp, texts: list[str], most: int = 1 << 20):
    """Ids of texts, a bounded number of characters at a time."""
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and (hi == lo or chars < most):
            chars += len(texts[hi])
            hi += 1
        yield from sp.encode(texts[lo:hi], num_threads=1)
        lo = hi


def boundaries(text: str, ids: list[int], size: np.ndarray, pairs: set, zones: list[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
    """Stable token boundaries inside each zone of a chunk: positions and tokens before them."""
    ends = np.cumsum(size[ids]) - 1  # the tokenizer puts one blank before the text
    if len(ends) == 0 or ends[-1] != len(text):
        return [([], []) for _ in zones]
    out = []
    for lo, hi in zones:
        found: tuple[list[int], list[int]] = ([], [])
        a, b = np.searchsorted(ends, [max(lo, 1), min(hi, len(text) - 1)], side="left")
        for k in range(int(a), min(int(b) + 1, len(ends) - 1)):
            p = int(ends[k])
            if 0 < p < len(text) and size[ids[k + 1]] > 0:  # not inside a character spelled in bytes
                if text[p - 1:p + 1].replace(" ", "▁") not in pairs:
                    found[0].append(p)
                    found[1].append(k + 1)
        out.append(found)
    return out


def whole_counts(model: str):
    def run(batches):
        sp, _, _ = tokenizer(model)
        for batch in batches:
            col = column(batch, "text")
            _, offsets = raw(col)
            counts = [len(x) for x in encode(sp, ["" if t is None else t for t in col.to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
    return run


def cut(chunk: int, overlap: int):
    """Overlapping chunks of each text, one row each."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                text = column(one, "text")[0].as_py()
                n_bytes = len(text.encode())
                borders = list(range(0, len(text), chunk))
                if len(borders) > 1 and len(text) - borders[-1] <= overlap:
                    borders.pop()
                for k, at in enumerate(borders):
                    lo = max(0, at - overlap)
                    last = k == len(borders) - 1
                    hi = len(text) if last else borders[k + 1] + overlap
                    yield pa.RecordBatch.from_pydict({
                        "row": [one.column(0)[0].as_py()], "doc_id": one.column(1), "n_bytes": [n_bytes], "part": [k], "at": [lo], "border": [at],
                        "next_border": [None if last else borders[k + 1]], "text": [text[lo:hi]]}, schema=CUT)
    return run


CUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("border", pa.int64()), ("next_border", pa.int64()), ("text", pa.string())])


def chunk_counts(model: str, overlap: int):
    def run(batches):
        sp, size, pairs = tokenizer(model)
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r, ids in zip(rows, encode(sp, [r["text"] for r in rows])):
                at, zones = r["at"], []
                for border in (r["border"] if r["part"] else None, r["next_border"]):
                    zones.append((0, -1) if border is None else (border - overlap - at, border + overlap - at))
                (lp, lc), (rp, rc) = boundaries(r["text"], ids, size, pairs, zones)
                out.append({"row": r["row"], "doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "part": r["part"], "last": r["next_border"] is None, "tokens": len(ids),
                            "left_at": [p + at for p in lp], "left_n": lc, "right_at": [p + at for p in rp], "right_n": rc})
            yield pa.RecordBatch.from_pylist(out, schema=COUNTED)
    return run


COUNTED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("part", pa.int64()), ("last", pa.bool_()), ("tokens", pa.int64()),
                     ("left_at", pa.list_(pa.int64())), ("left_n", pa.list_(pa.int64())), ("right_at", pa.list_(pa.int64())), ("right_n", pa.list_(pa.int64()))])


def spliced(counted: DataFrame) -> DataFrame:
    """One row per text: tokens up to the common boundaries, null where two neighbours have none in common."""
    order = Window.partitionBy("row").orderBy("part")
    nxt_at, nxt_n = F.lead("left_at").over(order), F.lead("left_n").over(order)
    pair = counted.withColumns({"next_at": nxt_at, "next_n": nxt_n}).withColumn("p", F.array_min(F.array_intersect("right_at", "next_at")))
    ended = F.when(F.col("last"), F.col("tokens")).otherwise(F.element_at("right_n", F.array_position("right_at", F.col("p")).cast("int")))
    skip = F.when(F.col("last"), F.lit(0)).otherwise(F.element_at("next_n", F.array_position("next_at", F.col("p")).cast("int")))
    ok = F.col("last") | F.col("p").isNotNull()
    return (pair.withColumn("net", F.when(ok, ended - skip))
            .groupBy("row", "doc_id", "n_bytes").agg(F.sum("net").alias("n_tokens"), F.min(ok).alias("ok"), F.count("*").alias("n_chunks")))


def count_tokens(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_chunks for every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = rows.where(~long).select("doc_id", "text").mapInArrow(whole_counts(model), "doc_id long, n_bytes long, n_tokens long").withColumn("n_chunks", F.lit(1).cast("long"))
    # written once: row numbers of a second scan may differ where the number of cores has changed
    result, todo = short, saved(rows.where(long))
    width = docs.sparkSession.sparkContext.defaultParallelism
    while True:
        parts = todo.mapInArrow(cut(chunk, overlap), "row long, doc_id long, n_bytes long, part long, at long, border long, next_border long, text string").repartition(4 * width, "row", "part")
        counted = parts.mapInArrow(chunk_counts(model, overlap), "row long, doc_id long, n_bytes long, part long, last boolean, tokens long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>")
        done = saved(spliced(counted))
        result = result.unionByName(done.where("ok").select("doc_id", "n_bytes", "n_tokens", "n_chunks"))
        failed = done.where(~F.col("ok")).select("row")
        if failed.isEmpty():
            return result
        overlap *= 8
        chunk = max(chunk, 4 * overlap)
        todo = todo.join(failed, "row", "left_semi")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    out = count_tokens(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "n_chunks")
