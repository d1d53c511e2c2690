"""The driver contract from any start folder, with and without the optional
parts, and the scratch rules."""
import os
import subprocess
import sys
import textwrap

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(code, cwd):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    return subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=cwd, env=env, capture_output=True, text=True,
                          timeout=300)


def test_queries_load_without_any_jar(tmp_path):
    """Neither queries() nor oracle_sql() may touch files beside the package."""
    out = _run(f"""
        import sys, zipfile
        sys.path.insert(0, {ROOT!r})
        def no(*a, **k): raise OSError("no archive may be read")
        zipfile.ZipFile = no
        import __spark_entry__ as e
        print(len(e.queries()) >= 53, set(e.oracle_sql()) <= set(e.queries()))
        """, tmp_path)
    assert out.stdout.split() == ["True", "True"], out.stderr


def test_queries_load_without_the_optional_parts(tmp_path):
    out = _run(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name in ("corpus_pipeline", "lexicor.llm"):
                    raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        print(len(e.queries()) >= 53, any(q.startswith("op") for q in e.queries()))
        """, tmp_path)
    assert out.stdout.split() == ["True", "False"], out.stderr


def test_workers_need_no_path_to_the_package(tmp_path):
    out = _run(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        import __spark_entry__ as e
        from lexicor.session import get_session, release_scratch
        spark = get_session(master="local[2]")
        print("hits", e.queries()["keyword_hits"](spark, "/root/testdata/sf0.001").count())
        release_scratch(spark)
        """, tmp_path)
    assert "hits 3" in out.stdout, out.stderr


def test_no_machine_local_scratch_on_a_cluster():
    from lexicor import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_hot_keys_are_looked_up_like_others(spark):
    from pyspark.sql import functions as F

    from lexicor.operators.joins import lookup
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 100 == 0, F.lit(None))
                                    .otherwise(F.col("id")).cast("long").alias("k"), "id")
    table = rows.where("k is not null and k % 2 = 1").groupBy("k").agg(F.count("*").alias("w")).withColumn("v", F.col("k") * 10)
    got = lookup(rows, table, "k", "w").collect()
    assert len(got) == 5000
    assert all(r.v == (r.k * 10 if r.k is not None and r.k % 2 else None) for r in got)
