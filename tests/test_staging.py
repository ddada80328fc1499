"""Where intermediate tables go, and when they go away."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest

from adlayer import staging


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, at=None: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: at), sparkContext=SimpleNamespace(master=master, applicationId=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            staging.shared_dir(session(master))
        assert staging.shared_dir(session(master, "hdfs://x/y")) == "hdfs://x/y"
    assert Path(staging.shared_dir(session("local[2]"))).is_dir()


def test_scratch_tables_go(spark):
    def tables():
        return {p.name.split("-")[0] for p in Path(staging.shared_dir(spark).removeprefix("file:")).iterdir()}

    with staging.scratch(spark):
        staging.stage(spark.range(3), "inner")
        kept = staging.stage(spark.range(4), "outlives", outer=True)
        assert {"inner", "outlives"} <= tables()
    assert "inner" not in tables() and kept.count() == 4
