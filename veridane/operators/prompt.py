"""Prompt assembly as column expressions. Templates and rule texts come from files; the package ships a set of its own."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridane.sources import files
from veridane.sources.scratch import package_text, shipped

#: Names of the rule languages as prompts show them.
DISPLAY = {"plain": "plain English", "odrl": "ODRL", "legalruleml": "LegalRuleML", "de_jure": "De Jure"}
#: Rule file of a language; plain has its rules in its section.
RULES = {"odrl": "policy.json", "legalruleml": "rules.xml", "de_jure": "units.json"}


def read_templates(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """Whole text files by name: base, with {dsl_section} and {dsl_name}, and a section for each language, with {rules}; format strings, in which literal braces are doubled. A few small files."""
    out = {}
    for name, path in paths.items():
        found = files.read_whole(spark, path).select("value").first()  # an empty file has no row
        out[name] = found["value"].removesuffix("\n") if found else ""
    return out


def own_templates() -> dict[str, str]:
    """The package's templates."""
    return {name: package_text("veridane.templates", f"{name}.txt").removesuffix("\n") for name in ("base", *DISPLAY)}


def shipped_prompts(spark: SparkSession) -> DataFrame:
    """(dsl, system) for each language, from template and rule files read as whole texts."""
    texts = read_templates(spark, {name: shipped(spark, "veridane.templates", f"{name}.txt") for name in ("base", *DISPLAY)})
    rules = read_templates(spark, {dsl: shipped(spark, "veridane.rulesets", name) for dsl, name in RULES.items()})
    named = spark.createDataFrame([(dsl, rules.get(dsl, "")) for dsl in DISPLAY], "dsl string, rules string")
    return named.select("dsl", system_prompt(F.col("dsl"), F.col("rules"), texts).alias("system"))


#: A doubled brace, a named field, or a brace that is neither.
MARK = re.compile(r"\{\{|\}\}|\{(\w+)\}|[{}]")


def formatted(template: str, fields: dict[str, Column]) -> Column:
    """A format string with its named fields filled in; doubled braces are single ones, and what is filled in is not looked at again. An unknown field or a single brace is an error."""
    parts, at = [], 0
    for m in MARK.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[1]:
            if m[1] not in fields:
                raise ValueError(f"unknown field {m[1]!r} in a template")
            parts.append(fields[m[1]])
        elif len(m[0]) == 2:
            parts.append(F.lit(m[0][0]))
        else:
            raise ValueError(f"a single {m[0]!r} in a template: {template[max(0, m.start() - 20) : m.end() + 20]!r}")
    return F.concat(*parts, F.lit(template[at:]))


def section(dsl: Column, rules: Column, templates: dict[str, str]) -> Column:
    """A language's section with its rules filled in."""
    out = F.lit(None).cast("string")
    for name in DISPLAY:
        out = F.when(dsl == name, formatted(templates[name], {"rules": rules})).otherwise(out)
    return out


def system_prompt(dsl: Column, rules: Column, templates: dict[str, str] | None = None) -> Column:
    """The base template with section and name filled in; names in any case; an unknown language is an error."""
    templates = templates or own_templates()
    low = F.lower(dsl)
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in DISPLAY.items() for x in kv]), low)
    filled = formatted(templates["base"], {"dsl_name": name, "dsl_section": section(low, F.coalesce(rules, F.lit("")), templates)})
    return F.when(low.isin(*DISPLAY), filled).otherwise(F.raise_error(F.concat(F.lit("Unsupported DSL: "), low)).cast("string"))


def default_prompt() -> Column:
    """The system prompt of code that names no language: plain."""
    return system_prompt(F.lit("plain"), F.lit(""))


def messages(system: Column, user: Column) -> Column:
    """System message, then user message, as ARRAY<STRUCT<role, content>>."""
    one = lambda role, text: F.named_struct(F.lit("role"), F.lit(role), F.lit("content"), text)
    return F.array(one("system", system), one("user", user))


def render(chat: Column) -> Column:
    """A generic chat rendering: role, line, content for each message."""
    return F.array_join(F.transform(chat, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"])), "\n")


def transcript(pairs: DataFrame) -> DataFrame:
    """(id, ground_truth, side, expected, prompt): pairs unpivoted, A before B."""
    from veridane.operators.score import expected_label

    sides = F.array(*[F.named_struct(F.lit("side"), F.lit(s), F.lit("expected"), expected_label(F.col("ground_truth"), s), F.lit("prompt"), F.col(f"prompt_{s}")) for s in "AB"])
    return pairs.select("id", "ground_truth", F.inline(sides))
