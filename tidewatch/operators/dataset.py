"""Assembly, sampling and evaluation of the labelled dataset."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, RegexTokenizer, StringIndexer, NGram, SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import mask_iocs, script_of

CLASSES = ("credential_leak", "malware_sample", "threat_actor_comms", "access_broker", "data_dump", "vulnerability")
TRUSTED = ("agree", "rules_protected")
COLUMNS = {"id", "text", "label", "language", "split", "content_hash", "collected_at"}
RELABEL_COLUMNS = ("id", "groq_category", "model_category", "model_severity", "model_confidence", "protected", "final_label", "source", "needs_review", "content_snippet")
POSITIVE = "relevant"


def plan_reason(include_reclassified: bool = False) -> Column:
    """What becomes of a relabelled row: actionable, downgrade, or why it is left out."""
    review = (F.col("source") == "reclassified") | (F.trim("needs_review") == "1")
    kept = F.lit(include_reclassified) & review
    return (
        F.when(F.col("source") == "no_verdict_keep_groq", "no_verdict")
        .when(F.col("source") == "downgrade", "downgrade")
        .when(review & ~kept, "needs_review_not_adjudicated")
        .when(~review & ~F.col("source").isin(*TRUSTED), F.concat(F.lit("unknown_source:"), F.col("source")))
        .when(~F.col("final_label").isin(*CLASSES), "final_label_not_a_class")
        .otherwise("actionable")
    )


def exclusion_reason(gold: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with ``excluded``: gold_set, content_missing_in_db, is_noise, empty_content, or null."""
    g = gold.select("id").distinct().withColumn("_gold", F.lit(True))
    reason = F.when(F.col("_gold"), "gold_set").when(F.col("content").isNull(), "content_missing_in_db").when(F.coalesce("is_noise", F.lit(False)), "is_noise").when(F.trim("content") == "", "empty_content")
    return rows.join(g, "id", "left").withColumn("excluded", reason).drop("_gold")


def credential_exits(relabel: DataFrame) -> DataFrame:
    """Rows that were credential leaks and are no longer."""
    return relabel.where((F.col("groq_category") == "credential_leak") & ~F.col("final_label").eqNullSafe("credential_leak"))


def to_review(relabel: DataFrame) -> DataFrame:
    return relabel.where((F.trim("needs_review") == "1") | (F.col("source") == "reclassified"))


def downgrades(relabel: DataFrame) -> DataFrame:
    return relabel.where(F.col("source") == "downgrade")


def original_irrelevant(raw: DataFrame) -> DataFrame:
    """Classified as irrelevant and no noise; an unset noise flag is none."""
    return raw.where(F.col("classified") & (F.col("category") == "irrelevant") & ~F.coalesce("is_noise", F.lit(False)))


def first_by_hash(rows: DataFrame) -> DataFrame:
    """The earliest row (time, id) of each content hash; rows without a hash are one group, as for an equal value.

    An aggregation, so a hot hash is reduced before the shuffle."""
    return rows.groupBy("content_hash").agg(F.min_by(F.struct(*rows.columns), F.struct("collected_at", "id")).alias("_r")).select("_r.*")


def label_conflicts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("content_hash").agg(F.countDistinct("label").alias("labels")).where("labels > 1")


def temporal_split(rows: DataFrame, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """By position in (time, id): the first int(0.8 n) train, the next int(0.1 n) val, the rest test.

    Positions come from buckets of an hour (rows without a time, which come first: of the first letters of their ids): rows
    before a bucket by a sum over buckets, rows within it by a window of the bucket, so no task holds all rows."""
    none = F.col("collected_at").isNull()
    x = rows.withColumn("_hour", F.when(none, -(10**9)).otherwise(F.floor(F.unix_seconds("collected_at") / 3600))).withColumn("_part", F.when(none, F.left("id", F.lit(3))).otherwise(""))
    hours = x.groupBy("_hour", "_part").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_hour", "_part")
    hours = hours.select("_hour", "_part", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    x = x.join(hours, ["_hour", "_part"]).withColumn("_p", F.col("_before") + F.row_number().over(Window.partitionBy("_hour", "_part").orderBy("collected_at", "id")))
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * train) + F.floor(F.col("_n") * val)
    return x.withColumn("split", F.when(F.col("_p") <= a, "train").when(F.col("_p") <= b, "val").otherwise("test")).drop("_hour", "_part", "_before", "_n", "_p")


def assemble(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, content, content_hash, collected_at, is_noise, label) -> the training table."""
    kept = exclusion_reason(gold, rows).where("excluded is null")
    x = temporal_split(first_by_hash(kept))
    return x.select("id", mask_iocs(F.col("content")).alias("text"), "label", script_of(F.col("content")).alias("language"), "split", "content_hash", "collected_at")


def split_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "label", "language").agg(F.count(F.lit(1)).alias("rows"))


def checked(df: DataFrame) -> DataFrame:
    """A dataset with its required columns and known splits, else an error."""
    missing = COLUMNS - set(df.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    if not df.where(~F.col("split").isin("train", "val", "test")).isEmpty():
        raise ValueError("unknown split values")
    return df


def stratified_sample(df: DataFrame, targets: dict[str, int], seed: int = 42, class_col: str = "label", cut: int = 4096) -> DataFrame:
    """For each class the rows of smallest seeded hash, as many as its target; contents cut."""
    want, share = F.lit(0), F.lit(0.0)
    sizes = {r[0]: r[1] for r in df.where(F.col(class_col).isin(*targets)).groupBy(class_col).count().collect()}
    for c, n in targets.items():
        want = F.when(F.col(class_col) == c, n).otherwise(want)
        # Hashes below this share of their range hold n rows but for odds of about 1e-15; only these are sorted.
        share = F.when(F.col(class_col) == c, min(1.0, (n + 8 * n**0.5 + 32) / max(1, sizes.get(c, 0)))).otherwise(share)
    h = F.xxhash64("id", F.lit(seed))
    few = df.where(h.cast("double") / F.lit(2.0**64) + F.lit(0.5) <= share)
    x = few.withColumn("_n", F.row_number().over(Window.partitionBy(class_col).orderBy(h, "id"))).where(F.col("_n") <= want).drop("_n")
    return x.withColumn("content", F.left("content", F.lit(cut))) if "content" in x.columns else x


def simple_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)


def worksheet(relabel: DataFrame, contents: DataFrame) -> DataFrame:
    """Rows to review, with the content or, where it is missing, its snippet."""
    x = relabel.join(contents.select("id", "content"), "id", "left")
    return x.select("id", F.coalesce(F.nullif(F.trim("content"), F.lit("")), "content_snippet").alias("content"), F.col("groq_category").alias("old_label"), F.col("final_label").alias("new_label"), F.col("source").alias("decision_source"), F.lit("").alias("verdict"), F.lit("").alias("notes"))


def verdict_summary(sheets: DataFrame) -> DataFrame:
    """Per sheet: correct, error, unsure, pending, other, and errors among the adjudicated (null if none)."""
    v = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    kind = F.when(v == "", "pending").when(v.isin("ok", "correct", "y", "yes"), "correct").when(v.isin("error", "wrong", "n", "no"), "error").when(v.isin("unsure", "?"), "unsure").otherwise("other")
    g = sheets.groupBy("sheet").agg(*[F.count_if(kind == k).alias(k) for k in ("correct", "error", "unsure", "pending", "other")])
    return g.withColumn("error_rate", F.try_divide(F.col("error").cast("double"), (F.col("correct") + F.col("error")).cast("double")))


def recall_threshold(scores: DataFrame, target: float = 0.97, buckets: int = 64) -> DataFrame:
    """(score, positive) -> the highest threshold whose recall is at least ``target``; minus infinity always qualifies.

    Running sums go over score ranges (cut at approximate quantiles) and within each, so no task sorts all scores."""
    by = scores.where("score is not null").groupBy("score").agg(F.sum(F.col("positive").cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    cuts = sorted(set(by.approxQuantile("score", [i / buckets for i in range(1, buckets)], 0.005)))
    bucket = F.lit(0)
    for c in cuts:
        bucket = bucket + (F.col("score") > c).cast("int")
    by = by.withColumn("_b", bucket)
    w = Window.orderBy(F.desc("_b"))
    per = by.groupBy("_b").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))
    per = per.select("_b", (F.sum("bp").over(w) - F.col("bp")).alias("p0"), (F.sum("bn").over(w) - F.col("bn")).alias("n0"), F.sum("bp").over(Window.partitionBy()).alias("all_p"))
    w = Window.partitionBy("_b").orderBy(F.desc("score"))
    x = by.join(per, "_b").select("score", (F.col("p0") + F.sum("p").over(w)).alias("tp"), (F.col("n0") + F.sum("n").over(w)).alias("flagged"), "all_p")
    x = x.where(F.col("tp") >= F.lit(target) * F.col("all_p"))
    return x.agg(F.max("score").alias("threshold"), F.max_by("tp", "score").alias("tp"), F.max_by("flagged", "score").alias("flagged"), F.max("all_p").alias("positives")).select(
        F.coalesce("threshold", F.lit(float("-inf"))).alias("threshold"), F.try_divide(F.col("tp").cast("double"), F.col("positives").cast("double")).alias("recall"), F.try_divide(F.col("tp").cast("double"), F.col("flagged").cast("double")).alias("precision")
    )


def class_metrics(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """(y, z) truth and prediction -> precision, recall and F1 per class (and group)."""
    by = list(by)
    cells = pairs.groupBy(*by, "y", "z").agg(F.count(F.lit(1)).alias("n"))
    each = cells.select(*by, F.explode(F.array_distinct(F.array("y", "z"))).alias("class"), "y", "z", "n")
    g = each.groupBy(*by, "class").agg(
        F.sum(F.when((F.col("y") == F.col("class")) & (F.col("z") == F.col("class")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("z") == F.col("class"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("y") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
    )
    p, r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted").cast("double")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    return g.select(*by, "class", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def macro_f1(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("f1").alias("macro_f1"))


def _piece(text: Column, size: int):
    return lambda at: F.substring(text, at, F.lit(size))


def char_grams(text: Column, low: int = 2, high: int = 5) -> Column:
    """Distinct-position character n-grams of the lower-cased text; none for texts shorter than ``low``."""
    # The lower-cased text is bound by a one-element transform, so that it is made once and not for every gram.
    lowered = F.array(F.lower(F.coalesce(text, F.lit(""))))
    return F.element_at(F.transform(lowered, lambda x: _grams(x, low, high)), 1)


def _grams(x: Column, low: int, high: int) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - n + 1), _piece(x, n))).otherwise(none) for n in range(low, high + 1)])


def pipeline(model: str = "svc", char_features: int = 300_000, word_features: int = 200_000, min_df: float = 2.0) -> Pipeline:
    """TF-IDF over characters and words, with a linear classifier. Input: text, chars (``char_grams``), label."""
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{N}]+")
    pairs = NGram(n=2, inputCol="words", outputCol="pairs")
    terms = SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__")
    parts, stages = [], [words, pairs, terms]
    for source, size in (("chars", char_features), ("terms", word_features)):
        stages += [CountVectorizer(inputCol=source, outputCol=f"{source}_tf", vocabSize=size, minDF=min_df), IDF(inputCol=f"{source}_tf", outputCol=f"{source}_idf")]
        parts.append(f"{source}_idf")
    stages += [VectorAssembler(inputCols=parts, outputCol="features"), StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc")]
    fit = {"svc": lambda: LinearSVC(labelCol="label_index", maxIter=30, weightCol="weight"), "logreg": lambda: LogisticRegression(labelCol="label_index", maxIter=50, weightCol="weight")}[model]
    return Pipeline(stages=[*stages, fit()])


def balanced(df: DataFrame) -> DataFrame:
    """Weights n / (classes * class size)."""
    c = df.groupBy("label").agg(F.count(F.lit(1)).alias("_c"))
    c = c.select("label", (F.sum("_c").over(Window.partitionBy()) / (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("_c"))).alias("weight"))
    return df.join(c, "label")


def train_gate(df: DataFrame, target: float = 0.97, **size) -> tuple[object, float, DataFrame]:
    """Stage 1: relevant against irrelevant; the threshold is set on val. Returns model, threshold and metrics of test."""
    x = balanced(checked(df).withColumn("chars", char_grams(F.col("text"))))
    model = pipeline("svc", **size).fit(x.where("split = 'train'"))
    positive = model.stages[-2].labels.index(POSITIVE)
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(x).withColumn("score", vector_to_array("rawPrediction")[positive])
    threshold = recall_threshold(scored.where("split = 'val'").select("score", (F.col("label") == POSITIVE).alias("positive")), target).first()["threshold"]
    z = F.when(F.col("score") >= threshold, POSITIVE).otherwise("irrelevant")
    return model, threshold, class_metrics(scored.where("split = 'test'").select(F.col("label").alias("y"), z.alias("z")))


def train_classes(df: DataFrame, **size) -> tuple[object, DataFrame]:
    """Stage 2: the category of relevant records, by multinomial regression over the same features. Returns the model and the
    metrics of val and test, each over all languages (language null) and by language."""
    x = balanced(checked(df).withColumn("chars", char_grams(F.col("text"))))
    model = pipeline("logreg", **size).fit(x.where("split = 'train'"))
    names = F.array(*[F.lit(n) for n in model.stages[-2].labels])
    z = model.transform(x.where("split <> 'train'")).select("split", "language", F.col("label").alias("y"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("z"))
    whole = class_metrics(z, ["split"]).withColumn("language", F.lit(None).cast("string"))
    return model, whole.unionByName(class_metrics(z, ["split", "language"]))


def error_table(summary: list[dict]) -> str:
    """Sheets of ``verdict_summary`` as a Markdown table."""
    lines = ["| sheet | rows | adjudicated | errors | unsure | pending | error rate |", "|---|---|---|---|---|---|---|"]
    for s in sorted(summary, key=lambda s: s["sheet"]):
        rows = sum(s[k] for k in ("correct", "error", "unsure", "pending", "other"))
        rate = "—" if s["error_rate"] is None else f"{s['error_rate']:.1%}"
        lines.append(f"| {s['sheet']} | {rows} | {s['correct'] + s['error']} | {s['error']} | {s['unsure']} | {s['pending']} | {rate} |")
    return "\n".join(lines)


def write_outputs(rows: DataFrame, folder: str) -> None:
    """The training table (stage 1), its relevant part (stage 2) and the statistics, each as a folder that replaces the old one."""
    rows.write.mode("overwrite").parquet(f"{folder}/stage1")
    rows.where(F.col("label") == POSITIVE).write.mode("overwrite").parquet(f"{folder}/stage2")
    split_stats(rows).coalesce(1).write.mode("overwrite").json(f"{folder}/stats")


def write_worksheet(sheet: DataFrame, path: str) -> None:
    sheet.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def report_markdown(metrics: list[dict], title: str) -> str:
    """Macro F1 first, then a line a class; never accuracy."""
    macro = sum(m["f1"] for m in metrics) / len(metrics) if metrics else 0.0
    lines = [f"# {title}", "", f"Macro F1: {macro:.4f}", "", "| class | precision | recall | F1 | support |", "| --- | --- | --- | --- | --- |"]
    return "\n".join([*lines, *(f"| {m['class']} | {m['precision']:.4f} | {m['recall']:.4f} | {m['f1']:.4f} | {m['support']} |" for m in sorted(metrics, key=lambda m: m["class"]))])
