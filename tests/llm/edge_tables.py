"""Edge-case copies of the smallest tables: empty, with nulls, repeated, long, with clashing columns."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

TABLES = ["document_versions", "document_observations", "pages", "questions", "question_occurrences", "desktop_answer_suggestions", "import_batches", "question_staging", "documents", "doc_labels", "subject_areas", "packing_specs", "eval_items"]
CLASHING = ["ckey", "cid", "grams", "bucket", "load_no2", "key", "keep_id", "src_table", "record_id", "rank", "vals", "line_no", "kind", "item_words", "n_tokens", "furniture", "seed", "blk"]


def _nulled(t: pa.Table, share: float, seed: int) -> pa.Table:
    r = random.Random(seed)
    return pa.table({n: pa.array([None if r.random() < share else v for v in t.column(n).to_pylist()], t.schema.field(n).type) for n in t.column_names})


def write(src: str, dst: Path, variant: str) -> str:
    for name in TABLES:
        t = pq.read_table(f"{src}/{name}.parquet")
        if variant == "empty":
            t = t.slice(0, 0)
        elif variant == "nulls":
            if name not in ("subject_areas", "packing_specs"):
                t = pa.concat_tables([t, _nulled(t, 0.3, 1), _nulled(t.slice(0, 20), 1.0, 2)])
        elif variant == "repeated":
            t = pa.concat_tables([t, t, t.slice(0, 30)])
        elif variant == "clashing":
            for c in CLASHING:
                if c not in t.column_names:
                    t = t.append_column(c, pa.array(["x"] * t.num_rows))
        elif variant == "long":
            for c in ("text", "statement"):
                if c in t.column_names and t.num_rows:
                    v = t.column(c).to_pylist()
                    long = " ".join(f"{w} palavra{n % 977}" for n, w in enumerate((v[0] or "texto").split() * 400))[:400_000]
                    v[0], v[1], v[2 % len(v)] = long, "", " \n\t "
                    t = t.set_column(t.column_names.index(c), c, pa.array(v, pa.string()))
        pq.write_table(t, dst / f"{name}.parquet")
    return str(dst)
