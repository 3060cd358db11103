"""Classification of layouts and matching of templates with pyspark.ml: TF-IDF of words and characters, forests and regressions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltide.functions.similarity import jaccard

#: Labelled texts on which a classifier is fitted at most; a bound on the driver's and the model's size.
MAX_FIT_ROWS = 50_000


def layout_model(samples: DataFrame, label: str = "label", text: str = "text", features: int = 1 << 14, seed: int = 5) -> PipelineModel:
    """Word 1- and 2-grams and characters 3-grams, hashed and weighted by IDF, under a multinomial regression.

    Of more than ``MAX_FIT_ROWS`` labelled rows about that many are taken, by a hash.
    """
    n = samples.count()
    if n > MAX_FIT_ROWS:
        samples = samples.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < int((1 << 20) * MAX_FIT_ROWS / n))
    stages = [
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^A-Za-z0-9+/:|,-]+"), NGram(inputCol="_w", outputCol="_w2", n=2),
        RegexTokenizer(inputCol=text, outputCol="_c", pattern="", gaps=True), NGram(inputCol="_c", outputCol="_c3", n=3),
    ]
    for c in ("_w", "_w2", "_c3"):
        stages += [HashingTF(inputCol=c, outputCol=f"{c}_tf", numFeatures=features), IDF(inputCol=f"{c}_tf", outputCol=f"{c}_idf")]
    stages += [VectorAssembler(inputCols=["_w_idf", "_w2_idf", "_c3_idf"], outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", probabilityCol="_prob", regParam=0.01, maxIter=30)]
    return Pipeline(stages=stages).fit(samples)


def classify(model: PipelineModel, texts: DataFrame, id_col: str = "id") -> DataFrame:
    """id, predicted label and its probability."""
    from pyspark.ml.functions import vector_to_array

    names = F.array(*(F.lit(x) for x in model.stages[0].labels))
    scored = model.transform(texts.withColumn(model.stages[0].getInputCol(), F.lit(model.stages[0].labels[0])))
    return scored.select(id_col, F.get(names, F.col("_p").cast("int")).alias("predicted"), F.array_max(vector_to_array("_prob")).alias("confidence"))


def layout_decision(form: float, carrier: float, mapping: float, carrier_name: str, mapped: int) -> tuple[float, bool]:
    """Overall confidence (.3, .4, .3) and whether a person must look: under .75, unknown carrier or under 3 mapped fields."""
    score = round(0.3 * form + 0.4 * carrier + 0.3 * mapping, 4)
    return score, score < 0.75 or carrier_name == "unknown" or mapped < 3


def char_grams(c: Column, n: int = 3) -> Column:
    low = F.lower(c)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n))))


def match_templates(files: DataFrame, templates: DataFrame, least: float = 0.7) -> DataFrame:
    """The best template (id, headers) of each file (id, headers) by the mean over its headers of the best 3-gram similarity.

    Templates are few and made by hand; files meet them through a join on shared 3-grams, not as all pairs.
    """
    f = files.select(F.col("id").alias("file_id"), F.posexplode("headers").alias("i", "h")).withColumn("g", char_grams(F.col("h")))
    t = templates.select(F.col("id").alias("template_id"), F.explode("headers").alias("th")).withColumn("tg", char_grams(F.col("th")))
    n = files.select(F.col("id").alias("file_id"), F.size("headers").alias("n"))
    shared = f.withColumn("k", F.explode("g")).join(t.withColumn("k", F.explode("tg")), "k").select("file_id", "i", "template_id", "th", "g", "tg").distinct()
    best = shared.withColumn("s", jaccard(F.col("g"), F.col("tg"))).groupBy("file_id", "template_id", "i").agg(F.max("s").alias("s"))
    score = best.groupBy("file_id", "template_id").agg(F.sum("s").alias("s")).join(n, "file_id").withColumn("score", F.round(F.col("s") / F.col("n"), 4)).where(F.col("score") >= least)
    return score.groupBy("file_id").agg(F.max_by("template_id", F.struct("score", -F.col("template_id"))).alias("template_id"), F.max("score").alias("score"))


def template_success(jobs: DataFrame, templates: DataFrame) -> DataFrame:
    """Uses and success rate (2 places) of each template; unused ones have 0 and null. ``jobs``: template_id, status."""
    u = jobs.where("template_id IS NOT NULL").groupBy("template_id").agg(F.count("*").alias("uses"), F.round(F.avg(F.when(F.col("status") == "completed", 1.0).otherwise(0.0)) * 100, 2).alias("success_rate"))
    return templates.select(F.col("id").alias("template_id")).join(u, "template_id", "left").withColumn("uses", F.coalesce("uses", F.lit(0).cast("bigint")))


def updated_accuracy(templates: DataFrame, feedback: DataFrame) -> DataFrame:
    """Running means: accuracy over uses, with each template's feedback (template_id, accuracy) taken in."""
    f = feedback.groupBy(F.col("template_id").alias("id")).agg(F.count("*").alias("_n"), F.sum("accuracy").alias("_s"))
    out = templates.join(f, "id", "left")
    n = F.coalesce("_n", F.lit(0).cast("bigint"))
    return out.select("id", (F.col("uses") + n).alias("uses"), F.when(n > 0, F.round((F.col("accuracy") * F.col("uses") + F.col("_s")) / (F.col("uses") + n), 4)).otherwise(F.col("accuracy")).alias("accuracy"))
