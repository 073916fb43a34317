"""One row per question record with its copy key and, if asked, its set of word pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lauda.llm import kernels as k
from lauda.session import table

#: Seeds that keep the two tables' hashes apart: pairs and copies never cross tables.
SEEDS = {"questions": 0x51, "question_staging": 0x57}
BASE = "src_table string, id string, load_no int, ver timestamp_ntz"


def question_texts(questions: DataFrame, *extra) -> DataFrame:
    """Stored questions as (src_table, id, load_no, ver, extra columns, body, alts).

    A null load_no counts as load 0, a row with a null id takes no part.
    """
    return questions.filter(F.col("id").isNotNull()).select(
        F.lit("questions").alias("src_table"),
        "id",
        F.coalesce("load_no", F.lit(0)).alias("load_no"),
        F.col("updated_at").cast("timestamp_ntz").alias("ver"),
        *extra,
        F.col("payload_json").alias("body"),
        F.lit(None).cast("string").alias("alts"),
    )


def staged_texts(staging: DataFrame) -> DataFrame:
    """Staged questions in the same form; staging has no load number and counts as one load."""
    return staging.filter(F.col("id").isNotNull()).select(
        F.lit("question_staging").alias("src_table"),
        "id",
        F.lit(0).alias("load_no"),
        F.col("created_at").cast("timestamp_ntz").alias("ver"),
        F.col("statement").alias("body"),
        F.col("alternatives").alias("alts"),
    )


def both_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_texts(table(spark, sf_dir, "questions")).unionByName(staged_texts(table(spark, sf_dir, "question_staging")))


def features(texts: DataFrame, grams: bool = False) -> DataFrame:
    """Texts to all their columns but the last two, plus ckey and, if asked, cid and grams.

    Payloads that don't parse and records without a letter or digit are left out: they have no copy
    and no near duplicate. grams are the sorted 64-bit hashes of the distinct pairs of neighbouring
    words as 32-bit hashes; cid names that set, so records with equal sets share a class. A task emits
    the set of a class only once per load (null afterwards), so a class that holds a third of all rows
    weighs as little as the others in what follows.
    """
    kept = texts.schema.fields[:-2]

    seen_limit = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in k.by_size(batches, len(kept), len(kept) + 1):
            srcs, bodies, alts = b.column(0).to_pylist(), b.column(len(kept)).to_pylist(), b.column(len(kept) + 1).to_pylist()
            rows, keys, docs = [], [], []
            for n, (src, body, alt) in enumerate(zip(srcs, bodies, alts)):
                q = k.parse_payload(body) if src == "questions" else k.parse_staged(body, alt)
                if q is None or (key := k.copy_key(*q)) is None:
                    continue
                rows.append(n)
                keys.append(key)
                if grams:
                    docs.append([k.words(q[0]), *(k.words(t) for _, t in q[1])])
            at = pa.array(rows, pa.int32())
            cols = [b.column(c).take(at) for c in range(len(kept))] + [pa.array(keys, pa.binary())]
            names = [f.name for f in kept] + ["ckey"]
            if grams:
                loads = b.column(2).to_pylist()
                g, off = k.gram_sets(docs)
                cids, dropped = [], np.zeros(len(rows), bool)
                for i, n in enumerate(rows):
                    c = xxhash.xxh3_64_intdigest(g[off[i] : off[i + 1]].tobytes(), seed=SEEDS[srcs[n]])
                    cids.append(c - (1 << 64) if c >> 63 else c)
                    dropped[i] = (c, loads[n]) in seen
                    seen.add((c, loads[n]))
                if len(seen) > seen_limit:
                    seen.clear()
                cols += [pa.array(cids, pa.int64()), k.list_array(g, off, dropped)]
                names += ["cid", "grams"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return texts.mapInArrow(run, schema + ", ckey binary" + (", cid bigint, grams array<int>" if grams else ""))


def members(feats: DataFrame) -> DataFrame:
    """One row per record: rows of one id are one record, the last updated row speaks for it; its
    load is the earliest that brought it."""
    keys = [c for c in ("ckey", "cid") if c in feats.columns]
    return feats.groupBy("src_table", "id").agg(
        F.min("load_no").alias("load_no"),
        F.max_by(F.struct(*keys), F.struct(F.col("ver").isNotNull(), F.col("ver"), F.col("load_no"), F.col("ckey"))).alias("last"),
    ).select("src_table", "id", "load_no", *[f"last.{c}" for c in keys])
