"""Media files come back from a table as they were, tensors and all; very long, repeated and clashing rows; tables are removed."""

import hashlib
import os

import numpy as np

from braidlex.llm import base, jpeg, media, queries


def test_query_stores_tensors(spark, tmp_path):
    rows = [(1, "abc", "x"), (1, "abc", "x"), (2, None, "x"), (None, "", "x"), (3, "é long " * 150_000, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, rgb string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.queries()["op9_media"](spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in out:
        file = jpeg.encode(jpeg.padded(texts[r.doc_id]))
        assert (r.n_bytes, r.media_bytes, r.media_sha256) == (len(texts[r.doc_id]), len(file), hashlib.sha256(file).hexdigest())
        rgb = jpeg.decode(file).rgb()
        assert (np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) == rgb).all() and r.feature == media.feature(rgb)
    path = base.run_dir(spark).removeprefix("file:")
    assert any(name.startswith("media-") for name in os.listdir(path))


def test_release_removes_the_tables_of_this_run(spark, monkeypatch):
    monkeypatch.setattr(base, "run_dir", lambda s: f"{base.shared_dir(s)}/braidlex/other-run")
    kept = base.cut(spark.range(3), "numbers")
    path = base.run_dir(spark)
    assert kept.count() == 3 and os.path.isdir(path)
    base.release(spark)
    assert not os.path.isdir(path)
