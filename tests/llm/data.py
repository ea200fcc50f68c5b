from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.01")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def docs_frame(spark, texts):
    """Documents with extra columns whose names clash with working names."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "x", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score double")
