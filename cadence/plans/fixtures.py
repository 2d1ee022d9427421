"""The operators' input shapes, made of the given tables. Times are multiples of 1/8 second, so all engines hold the same values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frames of a recording, four a second, for each of its words.
FRAMES_PER_WORD = 3
SPACES = r"[\x20\x09-\x0D]+"
#: Characters of a partition of dealt texts, about: its words and frames are sorted in memory.
DEALT_CHARS = 1_000_000
#: Joins on (recording, bucket) or (recording, line) leave rows that lie by recording where they are.
BY_RECORDING = ("spark.sql.requireAllClusterKeysForCoPartition", "false")


class Inputs:
    """Tables of one folder, and the shapes that are derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.dealt_chars = spark, sf_dir, DEALT_CHARS
        self._parts: int | None = None

    def table(self, name: str) -> DataFrame:
        """A table; one of texts that lies in no more pieces than there are cores is dealt out to all of them."""
        rows, cores = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"), self.spark.sparkContext.defaultParallelism
        return rows.repartition(cores) if name in ("documents", "conversations") and rows.rdd.getNumPartitions() <= cores else rows

    def dealt(self, *columns: str) -> DataFrame:
        """Columns of the documents, dealt by doc_id. A text is exchanged once, before it becomes many times as many bytes of
        words and frames: these lie by recording then, and so do all windows, joins and groups of recordings after that."""
        rows = self.spark.read.parquet(f"{self.sf_dir}/documents.parquet")
        self.spark.conf.set(*BY_RECORDING)
        return rows.select("doc_id", *columns).repartition(self.parts(), "doc_id")

    def parts(self) -> int:
        """How many partitions the texts are dealt in."""
        if self._parts is None:
            chars = self.spark.read.parquet(f"{self.sf_dir}/documents.parquet").agg(F.sum(F.char_length("text"))).first()[0] or 0
            self._parts = max(self.spark.sparkContext.defaultParallelism, -(-chars // self.dealt_chars))
        return self._parts

    @staticmethod
    def of_three(name: str) -> Column:
        """An id that three neighbouring rows share."""
        return (F.col(name) - F.pmod(F.col(name), F.lit(3))).cast("string")

    def recordings(self) -> DataFrame:
        label = F.when(F.col("doc_id") % 2 == 0, "kids").otherwise("normal")
        return self.dealt("lang").select(F.col("doc_id").alias("recording_id"), label.alias("label"), F.concat(F.lit("https://youtu.be/d"), F.col("doc_id").cast("string")).alias("source_url"), F.col("lang").alias("language"))

    def words(self) -> DataFrame:
        tokens = F.array_remove(F.split("text", SPACES), "")
        t = self.dealt("text").select(F.col("doc_id").alias("recording_id"), F.posexplode(tokens).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))
        at = 4 * F.col("pos") + (F.col("pos") - F.col("pos") % 9) + F.when(F.col("pos") % 11 == 0, 1).otherwise(0)
        length = F.when((F.col("pos") + F.col("recording_id")) % 7 == 0, 4).otherwise(2)
        label = F.when(F.col("recording_id") % 2 == 0, "kids").otherwise("normal")
        return t.select("recording_id", label.alias("label"), "pos", "word", (at.cast("double") / 8).alias("start_sec"), ((at + length).cast("double") / 8).alias("end_sec"))

    def frames(self) -> DataFrame:
        n = F.size(F.filter(F.split("text", SPACES), lambda x: x != ""))
        d = self.dealt("text").select(F.col("doc_id").alias("recording_id"), (FRAMES_PER_WORD * n).cast("long").alias("n")).filter("n > 0")
        d = d.select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
        v = (F.col("recording_id") * 31 + F.col("i") * 17) % 97
        f0 = F.when((F.col("recording_id") % 10 == 9) | (v < 20), 0.0).otherwise((75 + 5 * v).cast("double"))
        return d.select("recording_id", (F.col("i").cast("double") / 4).alias("t"), f0.alias("f0"))

    def segments(self) -> DataFrame:
        tokens = F.filter(F.split("text", SPACES), lambda x: x != "")
        t = self.table("conversations").select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("seg_pos"), F.posexplode(tokens).alias("word_pos", "word"))
        t = t.withColumn("word_pos", F.col("word_pos").cast("long"))
        k, at = F.col("seg_pos") + F.col("word_pos"), 200 * F.col("seg_pos") + 4 * F.col("word_pos")
        return t.select(
            "recording_id", "seg_pos", "word_pos", F.when(k % 19 == 0, "  ").otherwise(F.col("word")).alias("word"),
            F.when(k % 13 != 0, at.cast("double") / 8).alias("start_sec"), F.when(k % 17 != 0, (at + 3).cast("double") / 8).alias("end_sec"),
        )

    def manifest_lines(self) -> DataFrame:
        pages = self.table("pages").select("page_id")
        marker = F.when(F.col("page_id") % 100 == 0, "# LABEL: YOUTUBE_KIDS").otherwise("# label: normal")
        marks = pages.filter("page_id % 50 = 0").select((2 * F.col("page_id")).alias("line_no"), marker.alias("line"))
        urls = pages.select((2 * F.col("page_id") + 1).alias("line_no"), F.concat(F.lit("  https://youtu.be/v"), self.of_three("page_id"), F.lit(" ")).alias("line"))
        # a file for each hundred pages; their names sort as their lines do
        return marks.unionByName(urls).withColumn("file", F.concat(F.lit("manifest-"), F.lpad(F.floor(F.col("line_no") / 200).cast("string"), 12, "0")))

    def found(self) -> DataFrame:
        source = F.when(F.col("doc_id") % 2 == 0, "youtube_kids").otherwise("youtube")
        return self.table("documents").select(
            F.col("doc_id").alias("rank"), source.alias("source"), F.concat(F.lit("v"), self.of_three("doc_id")).alias("video_id"),
            F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("channel"), (F.col("n_chars") % 900).alias("duration"), F.lit("").alias("url"),
        )

    def metadata(self) -> DataFrame:
        own = F.struct("doc_id", "lang", "n_chars", F.substring_index("text", "\n", 1).alias("line"))
        d = self.table("documents").groupBy(self.of_three("doc_id").alias("v")).agg(F.min_by(own, "doc_id").alias("d")).select("v", "d.*")
        audio = F.when(F.col("doc_id") % 11 == 0, "none").otherwise("mp4a")
        return d.select(
            F.concat(F.lit("v"), "v").alias("video_id"),
            F.when(F.col("doc_id") % 17 == 0, "private").when(F.col("doc_id") % 5 != 0, "public").alias("availability"),
            F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")).alias("language"), (F.col("n_chars") % 900).alias("duration"),
            F.array(F.struct(F.lit("https://media").alias("url"), audio.alias("acodec"))).alias("formats"),
            F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("T"), "line")).alias("title"), F.lit("").alias("channel"),
        )

    def job_state(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderkey") % 13 == 0, "failed").when(F.col("o_orderkey") % 29 == 0, "interrupted").when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "P", "processing").otherwise("pending")
        )
        return self.table("orders").select(
            F.col("o_orderkey").alias("job_id"), F.concat(F.lit("https://youtu.be/o"), F.col("o_orderkey").cast("string")).alias("url"),
            F.when(F.col("o_custkey") % 2 == 0, "kids").otherwise("normal").alias("label"), status.alias("status"), (F.col("o_custkey") % 3).alias("attempts"),
        )

    def new_manifest(self) -> DataFrame:
        """job_state without every tenth entry, and with some that it doesn't know."""
        s = self.job_state().select("job_id", "label")
        m = s.filter("job_id % 10 <> 0").union(s.filter("job_id % 50 = 1").select((F.col("job_id") + 1000000).alias("job_id"), "label"))
        return m.select(F.col("job_id").alias("manifest_index"), F.concat(F.lit("https://youtu.be/o"), F.col("job_id").cast("string")).alias("url"), "label")

    def outputs(self) -> DataFrame:
        return self.table("lineitem").filter("l_quantity < 25").select(F.col("l_orderkey").alias("job_id")).distinct()

    def job_events(self, events: DataFrame | None = None) -> DataFrame:
        e = self.table("events") if events is None else events
        kind = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "click", "started").when(F.col("event_type") == "view", "progress").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
        stage = F.element_at(F.array(*map(F.lit, ("download", "vocal_isolation", "transcription_alignment", "prosody_analysis"))), (F.col("event_id") % 4 + 1).cast("int"))
        return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), stage.alias("stage"))

    def requests(self, events: DataFrame | None = None) -> DataFrame:
        u = F.col("user_id")
        return (self.table("events") if events is None else events).select(
            F.col("event_id").alias("request_no"), F.concat(F.when(u % 9 == 0, "https://example.com/").otherwise("https://youtu.be/"), u.cast("string")).alias("url"),
            F.when(F.col("event_id") % 7 == 0, "other").when(u % 2 == 0, "kids").otherwise("normal").alias("label"),
            F.when(F.col("event_id") % 11 == 0, "phone").when(u % 3 == 0, "word").otherwise("both").alias("granularity"),
            F.when(F.col("event_id") % 13 == 0, 10).otherwise(75).alias("pitch_floor"), F.when(F.col("event_id") % 17 == 0, 60).otherwise(600).alias("pitch_ceiling"),
        )
