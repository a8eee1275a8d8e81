"""Configuration files, format strings, and failures of prompts."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veridane.operators import config, extract, prompt


def test_configs_are_found_by_their_file_names(spark, tmp_path):
    folder = tmp_path / "configs"
    folder.mkdir()
    own = {"model_id": "another name", "torch_dtype": "float16", "seed": 3, "generation": {"do_sample": False, "temperature": 0.5}}
    (folder / "org_a b.1.json").write_text(json.dumps(own, indent=2))
    (folder / "meta-llama_Llama-3.2-1B-Instruct.json").write_text(json.dumps({"generation": {"max_new_tokens": 9, "temperature": None}}))
    asked = spark.createDataFrame([("org/a b.1",), ("another name",)], "model_id string")
    got = {r["model_id"]: tuple(r)[1:] for r in config.resolve(asked, config.read_configs(spark, str(folder))).collect()}
    assert got == {"org/a b.1": ("org_a b.1", "float16", 3, 0.5, True, 64), "another name": ("meta-llama_Llama-3.2-1B-Instruct", None, None, 0.0, False, 9)}
    with pytest.raises((PySparkException, Py4JJavaError), match="no configuration"):
        config.resolve(asked, config.read_configs(spark, str(folder)), "not/there").collect()
    (folder / "bad.json").write_text("{")
    with pytest.raises((PySparkException, Py4JJavaError)):
        config.read_configs(spark, str(folder)).collect()


def test_format_strings(spark, tmp_path):
    texts = {"base": 'A {dsl_name}: {dsl_section}\n{{"x": {{}}}} {dsl_name}', "odrl": "<{rules}> {{{rules}}}", "plain": "no field {{", "legalruleml": "", "de_jure": "{rules}"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    read = prompt.read_templates(spark, {name: str(tmp_path / name) for name in texts})
    df = spark.createDataFrame([("odrl", "a {dsl_name} {{ }"), ("plain", None), ("DE_JURE", None)], "d string, r string")
    got = [r["p"] for r in df.select(prompt.system_prompt(F.col("d"), F.col("r"), read).alias("p")).collect()]
    want = [texts["base"].format(dsl_name=n, dsl_section=texts[k].format(rules=r)) for k, n, r in (("odrl", "ODRL", "a {dsl_name} {{ }"), ("plain", "plain English", ""), ("de_jure", "De Jure", ""))]
    assert got == want


@pytest.mark.parametrize("bad", ["{", "}", "{other}", "a {dsl name}", "{}"])
def test_wrong_format_strings(bad):
    with pytest.raises(ValueError, match="template"):
        prompt.formatted(bad, {"dsl_name": None})


def test_failures_decide_before_responses(spark):
    good = f'{{"{extract.INFRINGING}": true, "{extract.SUBSTITUTE}": false}}'
    df = spark.createDataFrame([(1, good, None), (2, good, 'no "device"'), (3, None, ""), (4, "x", None)], "k int, raw string, why string")
    got = {r["k"]: (r["raw"], r["decision"], r["explanation"], r["parse_ok"]) for r in extract.decide(df, failure="why").collect()}
    assert got[1] == (good, "AWARDED", extract.rules.GRANTED, True) and got[4] == ("x", "DENIED", extract.PARSE_FAILED, False)
    assert got[2] == ('{"error":"prompt_failed","reason":"no \\"device\\""}', "DENIED", 'Prompt execution failed: no "device"', False)
    assert got[3][1:] == ("DENIED", "Prompt execution failed: ", False)
