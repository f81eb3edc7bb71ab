"""Subtitle files of many streams: whole and in order, listed by a few tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loquent.sources import files as S


def test_folders_of_many_streams_are_listed_by_few_tasks(spark, tmp_path):
    cues = spark.range(400).select((F.col("id") % 200).alias("stream_id"), (1 - F.floor(F.col("id") / 200)).alias("number"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.concat(F.lit("cue "), "id").alias("text"))
    S.write_subtitles(cues, str(tmp_path), "all")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, tracker = spark.conf.get(key), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        rows = S.read_subtitles(spark, str(tmp_path), "txt")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get(key) == before
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    # Folders are dealt to tasks; there used to be a task for each of the 200.
    assert 0 < sum(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism < 200
    got = {}
    for r in rows.withColumn("at", F.monotonically_increasing_id()).orderBy("stream_id", "at").collect():
        got.setdefault(r.stream_id, []).append(r.value)
    assert got == {k: [f"cue {k + 200}", f"cue {k}"] for k in range(200)}
    assert {(r.stream_id, r.n) for r in S.read_subtitles(spark, str(tmp_path), "vtt").groupBy("stream_id").agg(F.count("*").alias("n")).collect()} == {(k, 8) for k in range(200)}
