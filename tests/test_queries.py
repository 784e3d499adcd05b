"""Registered queries beside their SQL on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from meridion.plans.catalog import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
#: Iterative ones take seconds each; verify.py runs them all.
QUICK = """world_to_cell segment_intersection project_to_segment angle_between validate_rules config_fingerprint sanitize_payload parse_sse_frames
    slope flow_direction flow_accumulation minmax_normalize contour_segments structure_tensor segmentize interpolate_along locate_along chaikin_smooth resample
    bbox_join crossing_join split_at_points knn_join within_distance_join snap_to_nearest point_in_zone_join raster_lookup mask_intersect percentiles nearest_rank_quantile band_rates
    dominant_class count_by_class node_degree mutual_best od_demand ring_buffer_tail job_status idle_gaps phase_progress fold_latest_state assemble_document write_layers stream_job_status sort_by_area main_and_branches trade_degree""".split()


def plain(x):
    return round(x, 5) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    cur = con.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[cols.index(n)]) for n in names) for r in cur.fetchall()), key=repr)


def test_entry_point_without_a_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(queries()) > 120


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline", [False, True])
def test_the_rest_works_without_the_training_data_part(tmp_path, pipeline):
    """In a copy without that subpackage, with and without the pipeline file."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "meridion", tmp_path / "meridion", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (root / "corpus_pipeline.py").exists() else [])):
        shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 120 and set(e.oracle_sql()) <= set(q); assert 'pipeline' not in q and not any(k.startswith('op1') for k in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
