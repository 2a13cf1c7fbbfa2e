"""Every uploaded file ends in lines or among the rejects, and a stream goes on
where it stopped."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT, write_file
from test_golden import GURTZ_CSV, REVIT_CSV

from bomspark.plans.procurement import analyse_files
from bomspark.sinks.tables import REJECTS, read_tables, result_tables, write_tables
from bomspark.sources import files
from bomspark.streaming.uploads import ingested_bom, ingested_rejects, start_upload_ingest


def test_no_file_is_lost(spark, tmp_path):
    landing = str(tmp_path / "in")
    write_file(landing + "/project=a", "A.CSV", REVIT_CSV)
    write_file(landing + "/project=a", "b.Csv", GURTZ_CSV)
    write_file(landing + "/project=b", "_c.csv", REVIT_CSV)
    write_file(landing + "/project=b", ".d.csv", REVIT_CSV)
    write_file(landing + "/project=c", "e.csv", "")
    write_file(landing + "/project=c", "f.csv", "no,header\n")
    write_file(landing + "/project=c", "g.csv", '"open')
    write_file(landing + "/project=c", "readme.txt", "not a schedule")
    a = analyse_files(spark, landing, as_of="2026-01-01")
    tables = read_tables(spark, write_tables(result_tables(a), str(tmp_path / "out")))
    lines = {os.path.basename(r.file_id) for r in tables["Clean_BOM"].select("file_id").distinct().collect()}
    rejects = {os.path.basename(r.file_id): r.reason for r in tables[REJECTS].collect()}
    assert lines == {"A.CSV", "b.Csv"}
    assert set(rejects) == {"_c.csv", ".d.csv", "e.csv", "f.csv", "g.csv"}
    assert rejects["e.csv"] == files.REJECT_EMPTY and rejects["_c.csv"] == files.REJECT_HIDDEN


def test_stream_restart(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")

    def ingest():
        start_upload_ingest(spark, landing, out, available_now=True).awaitTermination()
        return ingested_bom(spark, out).count()

    write_file(landing + "/project=rv", "a.csv", REVIT_CSV)
    first = ingest()
    assert first > 0 and ingest() == first          # nothing new: nothing repeated
    write_file(landing + "/_old", "c.csv", REVIT_CSV)
    write_file(landing + "/project=rv", "d.csv", "")
    rejects = ingested_rejects(spark, out, landing).collect()  # what the stream passes over is told, too
    assert sorted(os.path.basename(r.file_id) for r in rejects) == ["c.csv", "d.csv"]
    shutil.rmtree(landing)                          # the landing folder is rotated
    write_file(landing + "/project=gz", "b.csv", GURTZ_CSV)
    assert ingest() > first                         # earlier output stays


def test_file_queries_run_from_any_folder(tmp_path):
    """Workers get the package from the session, not from the working folder."""
    write_file(str(tmp_path / "in" / "p1"), "a.csv", REVIT_CSV)
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from bomspark.session import get_session\n"
            "from bomspark.plans.procurement import clean_files\n"
            "spark = get_session('local[2]', shuffle_partitions=2)\n"
            "print('lines', clean_files(spark, 'in').bom_lines.count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "lines " in done.stdout and "lines 0" not in done.stdout, done.stderr[-2000:]
