"""Report cleaning against the published per-model result tables.

The rows below are the published values (per model and batch size: actual
and predicted iteration time and the printed error); the CNN file carries
one all-empty line that must be dropped.
"""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from perfweave.sources import reports

CNN = """Model,Batch Size,Actual (ms),Predicted (ms),Error
DenseNet121,64,57.88,68.19,17.8%
DenseNet121,128,59.05,68.99,16.8%
DenseNet121,256,60.69,71.10,17.2%
ResNet50,64,28.71,33.19,15.6%
ResNet50,128,29.39,33.87,15.2%
ResNet50,256,34.01,36.54,7.4%
VGG16,64,27.85,28.66,2.9%
VGG16,128,37.75,39.66,5.1%
VGG16,256,60.28,59.00,2.1%
,,,,
"""
MLP = """Model,Batch Size,Actual (ms),Predicted (ms),Error
AS-MLP,32,23.29,17.64,24.3%
AS-MLP,128,35.67,39.01,9.4%
AS-MLP,256,134.36,111.82,16.8%
MLP-Mixer,32,17.64,14.89,15.6%
MLP-Mixer,128,27.11,27.32,0.8%
MLP-Mixer,256,121.21,105.15,13.2%
ResMLP,32,17.65,13.41,24.0%
ResMLP,128,21.58,20.26,6.1%
ResMLP,256,29.2,28.35,2.9%
"""
TRANSFORMER = """Model,Batch Size,Actual (ms),Predicted (ms),Error
DeiT-Tiny,32,38.89,29.37,24.5%
DeiT-Tiny,48,41.99,36.54,13.0%
DeiT-Tiny,64,46.53,42.08,9.6%
DistilBERT,8,28.01,21.56,23.0%
DistilBERT,16,28.48,21.9,23.1%
DistilBERT,32,29.19,20.74,28.9%
Transformer,8,158.16,155.39,1.8%
Transformer,16,157.48,151.29,3.9%
Transformer,32,156.79,154.07,1.7%
ViT,4,41.82,33.01,21.1%
ViT,8,46.11,45.34,1.7%
ViT,16,60.42,57.8,4.3%
"""


def _write(text):
    d = tempfile.mkdtemp(prefix="pw-report-")
    p = os.path.join(d, "report.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


@pytest.mark.parametrize("text,n", [(CNN, 9), (MLP, 9), (TRANSFORMER, 12)])
def test_published_errors_are_absolute_pct_errors(spark, text, n):
    df = reports.clean_model_report(reports.read_report_csv(spark, _write(text)))
    rows = df.withColumn("derived", reports.abs_pct_error(F.col("Predicted"), F.col("Actual"))).collect()
    assert len(rows) == n   # the empty CNN line is dropped
    for r in rows:
        assert round(r["derived"], 1) == pytest.approx(r["Error"], abs=1e-9)


def test_error_column_is_derived_when_absent(spark):
    text = "\n".join(",".join(line.split(",")[:4]) for line in MLP.strip().splitlines()) + "\n"
    df = reports.clean_model_report(reports.read_report_csv(spark, _write(" " + text)))
    r = df.where(F.col("Model") == "MLP-Mixer").orderBy("Batch").first()
    assert r["Error"] == pytest.approx(100 * abs(14.89 - 17.64) / 17.64)


def test_to_num_cleaning(spark):
    df = spark.createDataFrame([("17.8%",), ("1e3 ms",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(reports.to_num("x")).collect()] == [17.8, 1000.0, None, None]


def test_ymax(spark):
    df = reports.clean_model_report(reports.read_report_csv(spark, _write(TRANSFORMER)))
    assert reports.report_ymax(df).first()["ymax"] == 158.16


def test_resolve_columns_by_name(spark):
    df = spark.createDataFrame([("a", "1", "2", "3")], ["MODEL", "batch size", "Actual x", "Predicted y"])
    cols = reports.resolve_columns(df)
    assert cols == {"model": "MODEL", "batch": "batch size", "actual": "Actual x",
                    "pred": "Predicted y", "error": None}


# The published unseen-GPU rows (family, GPU, full, base).
UNSEEN_ROWS = (
    ("CNN", "A100", 13.915, 15.942), ("CNN", "RTX 4000 Ada", 19.973, 21.24), ("CNN", "L4", 23.757, 25.905),
    ("CNN", "RTX 5090", 27.935, 28.841), ("MLP", "H100", 11.85, 54.492), ("MLP", "L40", 16.658, 57.6),
    ("MLP", "L40s", 19.24, 69.669), ("MLP", "RTX 4000 Ada", 20.145, 54.021), ("Transformer", "RTX 5090", 9.98, 10.303),
    ("Transformer", "A40", 11.927, 18.163), ("Transformer", "A100", 15.425, 18.217), ("Transformer", "L4", 20.465, 23.207))


@pytest.mark.parametrize("family", ["CNN", "MLP", "Transformer"])
def test_unseen_gpu_report_file(spark, tmp_path, family):
    """A two-predictor CSV: columns by fragment, numbers cleaned, incomplete rows dropped, sorted by GPU."""
    from perfweave.sources import reports
    mine = [r[1:] for r in UNSEEN_ROWS if r[0] == family]
    path = tmp_path / "unseen.csv"
    path.write_text(" Held-out GPU , Full model (ms),Base model (ms) \n"
                    + "".join(f"{g},{a} ms,{b}\n" for g, a, b in mine) + "broken,,1.0\n")
    got = [tuple(r) for r in reports.clean_unseen_report(
        reports.read_report_csv(spark, str(path)), "full model", "base model").collect()]
    assert got == sorted(mine)
    with pytest.raises(ValueError):
        reports.resolve_columns(spark.createDataFrame([(1,)], "x int"), reports.unseen_report_spec())
