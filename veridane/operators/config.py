"""Model configurations: lookup with a default, and settings derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The default model and the default limit of new tokens.
DEFAULT_MODEL, DEFAULT_NEW_TOKENS = "meta-llama/Llama-3.2-1B-Instruct", 64


def config_key(model_id: Column) -> Column:
    return F.replace(model_id, F.lit("/"), F.lit("_"))


CONFIG = "model_id STRING, torch_dtype STRING, trust_remote_code BOOLEAN, seed INT, generation STRUCT<do_sample:BOOLEAN,temperature:STRING,max_new_tokens:INT>"


def read_configs(spark: SparkSession, folder: str) -> DataFrame:
    """(key, torch_dtype, trust_remote_code, seed, temperature, max_new_tokens) of a folder of JSON files, read in one scan; the key is a file's name without .json, whatever stands in it. A malformed file is an error."""
    raw = spark.read.schema(CONFIG).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(folder)
    # A file, or a folder of that name with parts in it, as Spark writes them.
    key = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json(?:/[^/]*)?$", 1))
    return raw.select(key.alias("key"), "torch_dtype", F.coalesce("trust_remote_code", F.lit(False)).alias("trust_remote_code"), "seed", "generation.temperature", "generation.max_new_tokens")


def resolve(requests: DataFrame, configs: DataFrame, default: str = DEFAULT_MODEL) -> DataFrame:
    """requests (model_id) with their configuration, found by name, or that of the default model; without that either it is an error.

    configs: as `read_configs` gives them, a small folder's rows; its size is up to Spark's own broadcast check.
    """
    own = requests.select("model_id", config_key(F.col("model_id")).alias("wanted")).join(configs, F.col("wanted") == F.col("key"), "left")
    fall = configs.filter(F.col("key") == default.replace("/", "_")).select(F.struct(*configs.columns).alias("d")).limit(1)
    picked = own.join(fall, F.lit(True), "left")
    found = F.when(F.col("key").isNotNull(), F.struct(*[F.col(c) for c in configs.columns])).otherwise(F.col("d"))
    picked = picked.select("model_id", F.coalesce(found, F.raise_error(F.lit(f"no configuration of {default}")).cast(configs.schema)).alias("c"))
    temperature = F.coalesce(F.col("c.temperature").try_cast("double"), F.lit(0.0))
    return picked.select("model_id", F.col("c.key").alias("config"), "c.torch_dtype", "c.seed", temperature.alias("temperature"), (temperature > 0).alias("do_sample"), F.coalesce("c.max_new_tokens", F.lit(DEFAULT_NEW_TOKENS)).alias("max_new_tokens"))
