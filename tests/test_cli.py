"""The command line on CSV files written from the smallest tables."""

import json
import subprocess
import sys

from lcspark.plans import bindings as B
from lcspark.sources import io as S

SF = "/root/testdata/sf0.001"


def test_cli_padded_table_from_csv(spark, tmp_path):
    obs = B.obs_event(spark, SF).select("object_id", "mjd", "passband", "flux", "flux_err", "detected")
    meta = B.meta_event(spark, SF)
    o, m = str(tmp_path / "obs.csv"), str(tmp_path / "meta.csv")
    obs.coalesce(1).write.option("header", True).csv(o)
    meta.coalesce(1).write.option("header", True).option("nullValue", "nan").csv(m)
    # the folders written by Spark are read back as CSV through their files
    o_csv = next(p for p in (tmp_path / "obs.csv").iterdir() if p.suffix == ".csv")
    m_csv = next(p for p in (tmp_path / "meta.csv").iterdir() if p.suffix == ".csv")
    root = str(__import__("pathlib").Path(__file__).resolve().parents[1])
    out = str(tmp_path / "padded")
    r = subprocess.run([sys.executable, "-m", "lcspark", "padded", "--obs", str(o_csv), "--meta", str(m_csv),
                        "--out", out, "--length", "16", "--augment"],
                       cwd=root, capture_output=True, text=True, timeout=600)
    assert r.returncode == 0, r.stderr[-2000:]
    assert json.loads(r.stdout.strip().splitlines()[-1])["table"] == out
    t = S.read_table(spark, out)
    assert t.count() == obs.select("object_id").distinct().count()
