"""Listing many folders takes few tasks, and contents that are read again are not shuffled."""

from __future__ import annotations

from loomspark.plans import catalog
from loomspark.sources import files


def test_folders_are_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LISTING", 3)
    for i in range(60):
        (tmp_path / f"f{i}" / "g").mkdir(parents=True)
        (tmp_path / f"f{i}" / "g" / "a.txt").write_text(f"text {i}")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.sparkContext.setJobGroup("listing", "listing")
    found = files.discover(spark, str(tmp_path))
    spark.sparkContext.setJobGroup("other", "other")
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 3
    assert spark.conf.get(name) == before
    assert sorted(r.relative_path for r in found.select("relative_path").collect()) == sorted(f"f{i}/g/a.txt" for i in range(60))


def test_contents_of_files_are_not_shuffled(spark):
    plan = catalog.QUERIES["file_inventory"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("binaryFile") == 1 and "BroadcastHashJoin [path" in plan and "SortMergeJoin [path" not in plan
