"""Queries of prompts, configurations, vectors and simple profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridane.operators import config, prompt, score, vector
from veridane.plans.registry import register, table
from veridane.sources import files
from veridane.sources.scratch import fresh, package_text, shipped_folder

#: The templates as SQL needs them: with single braces.
OWN = {name: text.replace("{{", "{").replace("}}", "}") for name, text in prompt.own_templates().items()}
DSL = "CASE conv_id % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'ODRL' WHEN 2 THEN 'legalruleml' ELSE 'de_jure' END"
SECTION = f"CASE lower({DSL}) " + " ".join(f"WHEN '{k}' THEN replace('{OWN[k]}', '{{rules}}', text)" for k in prompt.DISPLAY) + " END"
NAME = f"CASE lower({DSL}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in prompt.DISPLAY.items()) + " END"
SYSTEM = f"replace(replace('{OWN['base']}', '{{dsl_name}}', {NAME}), '{{dsl_section}}', {SECTION})"


def prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    dsl = F.when(F.col("conv_id") % 4 == 0, "plain").when(F.col("conv_id") % 4 == 1, "ODRL").when(F.col("conv_id") % 4 == 2, "legalruleml").otherwise("de_jure")
    return c.select("conv_id", "turn", "text", prompt.system_prompt(dsl, F.col("text")).alias("system"))


@register("prompt_build", f"SELECT conv_id, turn, {SYSTEM} AS system FROM conversations")
def prompt_build(spark, sf_dir):
    return prompted(spark, sf_dir).select("conv_id", "turn", "system")


@register("message_array", f"SELECT conv_id, turn, 2::BIGINT AS n, 'system,user' AS roles, '<|system|>' || chr(10) || {SYSTEM} || chr(10) || '<|user|>' || chr(10) || text AS rendered FROM conversations")
def message_array(spark, sf_dir):
    m = prompted(spark, sf_dir).withColumn("m", prompt.messages(F.col("system"), F.col("text")))
    return m.select("conv_id", "turn", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), prompt.render(F.col("m")).alias("rendered"))


def sql_shipped(dsl: str) -> str:
    rules = package_text("veridane.rulesets", prompt.RULES[dsl]).removesuffix("\n") if dsl in prompt.RULES else ""
    whole = OWN["base"].replace("{dsl_name}", prompt.DISPLAY[dsl]).replace("{dsl_section}", OWN[dsl].replace("{rules}", rules))
    return "'" + whole.replace("'", "''") + "'"


@register("prompt_from_files", f"SELECT conv_id, turn, md5(CASE lower({DSL}) " + " ".join(f"WHEN '{k}' THEN {sql_shipped(k)}" for k in prompt.DISPLAY) + " END || chr(10) || text) AS digest FROM conversations")
def prompt_from_files(spark, sf_dir):
    """Messages under the prompt of a language, from template and rule files read whole."""
    c = table(spark, sf_dir, "conversations")
    dsl = F.when(F.col("conv_id") % 4 == 0, "plain").when(F.col("conv_id") % 4 == 1, "odrl").when(F.col("conv_id") % 4 == 2, "legalruleml").otherwise("de_jure")
    asked = c.withColumn("dsl", dsl).join(F.broadcast(prompt.shipped_prompts(spark)), "dsl")  # four rows
    return asked.select("conv_id", "turn", F.md5(F.concat("system", F.lit("\n"), "text")).alias("digest"))


@register("default_prompt", f"SELECT conv_id, turn, md5({sql_shipped('plain')} || text) AS digest FROM conversations")
def default_prompt(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.concat(prompt.default_prompt(), F.col("text"))).alias("digest"))


#: Configuration files of the package.
CONFIGS = ("meta-llama_Llama-3.2-1B-Instruct", "microsoft_Phi-4-mini-instruct", "warm_model", "odd_model")


@register(
    "config_resolve",
    """SELECT DISTINCT * FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN 'unknown/model' WHEN 1 THEN 'meta-llama/Llama-3.2-1B-Instruct' WHEN 2 THEN 'microsoft/Phi-4-mini-instruct' WHEN 3 THEN 'warm/model' ELSE 'odd/model' END AS model_id FROM customer)
    JOIN (VALUES ('unknown/model', 'meta-llama_Llama-3.2-1B-Instruct', 'float16', 0, 0.0::DOUBLE, false, 1024), ('meta-llama/Llama-3.2-1B-Instruct', 'meta-llama_Llama-3.2-1B-Instruct', 'float16', 0, 0.0, false, 1024),
      ('microsoft/Phi-4-mini-instruct', 'microsoft_Phi-4-mini-instruct', 'auto', 0, 0.0, false, 1024), ('warm/model', 'warm_model', 'bfloat16', 7, 0.7, true, 64), ('odd/model', 'odd_model', 'auto', 1, 0.0, false, 8))
      v(model_id, config, torch_dtype, seed, temperature, do_sample, max_new_tokens) USING (model_id)""",
)
def config_resolve(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("unknown/model", "meta-llama/Llama-3.2-1B-Instruct", "microsoft/Phi-4-mini-instruct", "warm/model", "odd/model")])
    asked = table(spark, sf_dir, "customer").select(F.get(names, (F.col("c_custkey") % 5).cast("int")).alias("model_id")).distinct()
    return config.resolve(asked, config.read_configs(spark, shipped_folder(spark, "veridane.model_configs", [f"{name}.json" for name in CONFIGS])))


PAIRED = """WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of even number with the one behind them, as one aggregate by pair."""
    e = table(spark, sf_dir, "embeddings").withColumn("pair", F.expr("vec_id div 2"))
    side = lambda k: F.max(F.when(F.col("vec_id") % 2 == k, F.col("embedding")))
    both = e.groupBy("pair").agg(side(0).alias("a"), side(1).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return both.select((F.col("pair") * 2).alias("vec_id"), "a", "b")


def spread(df: DataFrame, column: str) -> DataFrame:
    """A row for each component."""
    return df.select("vec_id", F.posexplode(column).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"))


def sql_spread(expr: str) -> str:
    return f"{PAIRED}, v AS (SELECT vec_id, {expr} AS v FROM p) SELECT vec_id, unnest(range(len(v))) AS pos, round(unnest(v), 5) AS x FROM v"


@register("vec_diff", sql_spread("list_transform(list_zip(a, b), lambda z: z[1] - z[2])"))
def vec_diff(spark, sf_dir):
    return spread(paired(spark, sf_dir).select("vec_id", vector.difference(F.col("a"), F.col("b")).alias("v")), "v")


@register("vector_file", "SELECT vec_id::VARCHAR AS vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm, len(embedding)::BIGINT AS n FROM embeddings")
def vector_file(spark, sf_dir):
    """All vectors through a file."""
    path = fresh(spark, "vectors")
    files.write_vectors(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")), path)
    return files.read_vectors(spark, path).select("vec_id", F.round(vector.norm(F.col("vector")), 5).alias("norm"), F.size("vector").cast("long").alias("n"))


@register("vec_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm FROM embeddings")
def vec_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 5).alias("norm"))


@register("vec_steer", sql_spread("list_transform(list_zip(a, b), lambda z: z[1] - 3.8 * z[2])"))
def vec_steer(spark, sf_dir):
    return spread(paired(spark, sf_dir).select("vec_id", vector.steer(F.col("a"), F.col("b"), -3.8).alias("v")), "v")


@register("vec_phases", f"{PAIRED}, v AS (SELECT vec_id, 'baseline' AS phase, a AS v FROM p UNION ALL SELECT vec_id, 'intervention', list_transform(list_zip(a, b), lambda z: z[1] - 3.8 * z[2]) FROM p) SELECT vec_id, phase, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS norm FROM v")
def vec_phases(spark, sf_dir):
    both = F.array(*[F.named_struct(F.lit("phase"), F.lit(n), F.lit("v"), vector.steer(F.col("a"), F.col("b"), alpha)) for n, alpha in (("baseline", 0.0), ("intervention", -3.8))])
    return paired(spark, sf_dir).select("vec_id", F.inline(both)).select("vec_id", "phase", F.round(vector.norm(F.col("v")), 5).alias("norm"))


@register("answer_distribution", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def answer_distribution(spark, sf_dir):
    return score.distribution(table(spark, sf_dir, "orders"), "o_orderpriority")


@register("majority_baseline", "WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority) SELECT max(n) AS most, sum(n)::BIGINT AS total, round(max(n) / sum(n), 6) AS baseline FROM c")
def majority_baseline(spark, sf_dir):
    return score.majority_baseline(table(spark, sf_dir, "orders"), "o_orderpriority")


@register("null_profile", "SELECT count(*) AS records, count(*) - count(nullif(c_mktsegment, 'BUILDING')) AS null_domain FROM customer")
def null_profile(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("domain"))
    return c.agg(F.count("*").alias("records"), F.count(F.when(F.col("domain").isNull(), 1)).alias("null_domain"))


@register("null_listing", "SELECT c_custkey AS id FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL")
def null_listing(spark, sf_dir):
    """The records without a domain."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("domain"))
    return c.filter("domain IS NULL").select("id")
