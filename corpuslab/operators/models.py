"""Calls of models over tables: a client protocol, a deterministic stand-in and the pipelines around them."""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import gate_of, json_complies, label_complies, refusal_kind, refused, refused_cleanly, token_estimates, verdict_of
from corpuslab.operators.runs import repeat_stats
from corpuslab.session import cut_lineage

REFUSAL_SENTENCE = "That is not covered in the club documents."


class ModelClient(Protocol):
    """Anything that answers a prompt; errors are raised."""

    def complete(self, model: str, prompt: str, temperature: float, seed: int) -> tuple[str, float, int, int]:
        """The answer, seconds, and prompt and completion tokens."""
        ...


class StubClient:
    """A deterministic stand-in without a model: it quotes the prompt. Its output says nothing about any model."""

    def complete(self, model: str, prompt: str, temperature: float, seed: int) -> tuple[str, float, int, int]:
        """The end of the prompt, varied by a hash of all inputs only where the temperature is above 0."""
        salt = f"{model}|{prompt}|{seed if temperature > 0 else 0}|{temperature}"
        digest = int(hashlib.md5(salt.encode()).hexdigest()[:8], 16)
        words = prompt.split()
        if digest % 7 == 0:
            text = REFUSAL_SENTENCE
        else:
            keep = 8 + (digest % 5 if temperature > 0 else 0)
            text = " ".join(words[-keep:])
        if "SUPPORTED or UNSUPPORTED" in prompt:
            text = ("SUPPORTED", "UNSUPPORTED", "REFUSED")[digest % 3]
        elif "COVERED or MISSING" in prompt:
            text = ("COVERED", "MISSING")[digest % 2]
        return text, 0.5 + digest % 100 / 100, len(words), len(text.split())


def call_model(rows: DataFrame, key: str, prompt: Column, client: ModelClient, model: str, temperature: Column | None = None, seed: Column | None = None) -> DataFrame:
    """`(key, answer, seconds, tokens_in, tokens_out, ok)`: one call per row; an error becomes `[Type: message]`.

    The result is written to the checkpoint folder at once, so that nothing that reads it later calls a model again.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, p, t, s in batch[[key, "_p", "_t", "_s"]].itertuples(index=False):
                try:
                    out.append((k, *client.complete(model, p, float(t), int(s)), True))
                except Exception as e:  # noqa: BLE001
                    out.append((k, f"[{type(e).__name__}: {e}]", 0.0, 0, 0, False))
            yield pd.DataFrame(out, columns=[key, "answer", "seconds", "tokens_in", "tokens_out", "ok"])

    asked = rows.select(key, F.coalesce(prompt, F.lit("")).alias("_p"), (temperature if temperature is not None else F.lit(0.0)).alias("_t"), (seed if seed is not None else F.lit(7)).alias("_s"))
    return cut_lineage(asked.mapInPandas(run, f"{key} {kind}, answer string, seconds double, tokens_in long, tokens_out long, ok boolean"))


class Warm:
    """A client that makes one call for each model before the first that counts, so that loading is in no one's seconds."""

    def __init__(self, client: ModelClient) -> None:
        self.client = client
        self.warmed: set[str] = set()

    def complete(self, model: str, prompt: str, temperature: float, seed: int) -> tuple[str, float, int, int]:
        """The client's answer; errors of the first call are left for the one that counts."""
        if model not in self.warmed:
            self.warmed.add(model)
            with contextlib.suppress(Exception):
                self.client.complete(model, "hi", 0.0, seed)
        return self.client.complete(model, prompt, temperature, seed)


def run_cases(cases: DataFrame, client: ModelClient, models: tuple[str, ...], seed: int = 7) -> DataFrame:
    """`(model, case_id, kind, ok, seconds, tok_s, answer)` of stated cases `(case_id, question, context, fact)`.

    A case with a fact is grounded: the answer must contain it, whatever the case, and not refuse. A case without one must
    be refused without naming an amount of money. An empty context is allowed. Models warm up before their first case.
    """
    each = []
    for m in models:
        prompt = F.concat_ws("\n\n", F.coalesce("context", F.lit("")), F.coalesce("question", F.lit("")))
        said = call_model(cases, "case_id", prompt, Warm(client), m, seed=F.lit(seed))
        each.append(cases.select("case_id", "fact").join(said, "case_id").withColumn("model", F.lit(m)))
    joined = reduce(DataFrame.unionByName, each)
    must_refuse = F.col("fact").isNull()
    held = F.contains(F.lower("answer"), F.lower("fact")) & ~refused(F.col("answer"))
    rate = F.when(F.col("seconds") > 0, F.round(F.col("tokens_out") / F.col("seconds"), 1)).otherwise(0.0)
    return joined.select("model", "case_id", F.when(must_refuse, "refusal").otherwise("grounded").alias("kind"), F.when(must_refuse, refused_cleanly(F.col("answer"))).otherwise(held).alias("ok"), F.round("seconds", 2).alias("seconds"), rate.alias("tok_s"), "answer")


#: The three tasks and what their answers must look like.
SENTIMENTS = ("positive", "neutral", "negative")
EXTRACT_KEYS = ("topic", "action_required", "deadline")
TASKS = {
    "sentiment": "Classify the sentiment of a message. Reply with exactly one word: positive, neutral, or negative.",
    "summarize": "Summarise this document in one sentence. Use only what the document says.",
    "extract": "Return JSON only with exactly these keys: topic, action_required, deadline.",
}


def run_tasks(texts: dict[str, DataFrame], client: ModelClient, model: str) -> DataFrame:
    """`(task, id, seconds, tokens_in, tokens_out, ok)` of the three tasks over `(id, text)` inputs for each.

    An answer complies if it is one of the sentiments, any text that is no error, or an object with exactly the keys.
    """
    checks = {"sentiment": lambda a: label_complies(a, SENTIMENTS), "summarize": lambda a: (F.length(F.trim(a)) > 0) & ~F.startswith(a, F.lit("[")), "extract": lambda a: json_complies(a, EXTRACT_KEYS)}
    out = []
    for task, inputs in texts.items():
        said = call_model(inputs, "id", F.concat(F.lit(TASKS[task] + "\n\n"), F.coalesce("text", F.lit(""))), client, model)
        out.append(said.select(F.lit(task).alias("task"), "id", "seconds", "tokens_in", "tokens_out", checks[task](F.col("answer")).alias("ok")))
    return reduce(DataFrame.unionByName, out)


def noise_floor(prompts: DataFrame, prompt: str, client: ModelClient, model: str, runs: int = 10, seed: int = 7) -> DataFrame:
    """What changes between identical calls: the statistics of `runs` calls of every prompt at temperature 0 and one seed."""
    calls = prompts.select(prompt, F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run")).withColumn("call_id", F.md5(F.concat_ws("|", prompt, F.col("run").cast("string"))))
    said = call_model(calls, "call_id", F.col(prompt), client, model, F.lit(0.0), F.lit(seed))
    return repeat_stats(calls.join(said, "call_id"), [prompt], "answer")


def temperature_identity(prompts: DataFrame, key: str, prompt: str, client: ModelClient, model: str) -> DataFrame:
    """`(key, same, varied)`: whether two calls at temperature 0 agree, and whether one at 1 differs from them."""
    runs = [call_model(prompts, key, F.col(prompt), client, model, F.lit(t)).select(key, F.col("answer").alias(n)) for n, t in (("a", 0.0), ("b", 0.0), ("c", 1.0))]
    return runs[0].join(runs[1], key).join(runs[2], key).select(key, (F.col("a") == F.col("b")).alias("same"), (F.col("a") != F.col("c")).alias("varied"))


def grounded_and_plain(questions: DataFrame, client: ModelClient, model: str) -> DataFrame:
    """`(qid, plain, grounded, cost_plain, cost_grounded)` of `(qid, question, context)`: each question asked twice.

    Costs are estimated tokens of the prompts; a null context says that no document matched.
    """
    shown = F.coalesce("context", F.lit("[no documents matched this question]"))
    with_context = F.concat(F.lit("CLUB DOCUMENTS:\n"), shown, F.lit("\n\nQUESTION: "), "question")
    plain = call_model(questions, "qid", F.col("question"), client, model).select("qid", F.col("answer").alias("plain"))
    grounded = call_model(questions, "qid", with_context, client, model).select("qid", F.col("answer").alias("grounded"))
    cost = {n: token_estimates(c)["by_words"].alias(n) for n, c in (("cost_plain", F.col("question")), ("cost_grounded", with_context))}
    return questions.select("qid", *cost.values()).join(plain, "qid").join(grounded, "qid").select("qid", "plain", "grounded", "cost_plain", "cost_grounded")


def stamp(df: DataFrame, **config: object) -> DataFrame:
    """Rows with the configuration of their run as a struct column."""
    return df.withColumn("config", F.struct(*[F.lit(v).alias(k) for k, v in config.items()]))


def judge_pipeline(questions: DataFrame, client: ModelClient, answerer: str, judge: str, gate: str | None = None) -> DataFrame:
    """Answers and verdicts for `(qid, question, context)`: gate, answer, judge.

    A question that the gate calls MISSING gets the refusal sentence without a call; one it cannot decide is answered.
    Raises if gate and judge are the same model.
    """
    if gate is not None and gate == judge:
        raise ValueError("gate and judge must be different models")
    asked = questions.select("qid", "question", "context")
    if gate is not None:
        said = call_model(asked, "qid", F.concat(F.lit("COVERED or MISSING? "), "question", F.lit(" "), "context"), client, gate)
        asked = asked.join(said.select("qid", gate_of(F.col("answer")).alias("gate")), "qid")
    else:
        asked = asked.withColumn("gate", F.lit(None).cast("string"))
    open_ = asked.filter(F.coalesce(F.col("gate"), F.lit("")) != "MISSING")
    answered = call_model(open_, "qid", F.concat("context", F.lit("\n\n"), "question"), client, answerer).select("qid", "answer", "seconds")
    shut = asked.filter("gate = 'MISSING'").select("qid", F.lit(REFUSAL_SENTENCE).alias("answer"), F.lit(0.0).alias("seconds"))
    answers = asked.join(answered.unionByName(shut), "qid").withColumn("refusal", refusal_kind(F.col("answer")))
    to_judge = answers.filter("refusal is null")
    ruled = call_model(to_judge, "qid", F.concat(F.lit("SUPPORTED or UNSUPPORTED? "), "answer", F.lit(" "), "context"), client, judge)
    verdicts = answers.join(ruled.select("qid", verdict_of(F.col("answer")).alias("_v")), "qid", "left")
    return verdicts.select("qid", "gate", "answer", "refusal", F.coalesce("_v", F.lit("REFUSED")).alias("verdict"), "seconds")


def grid(prompts: DataFrame, prompt: str, temperatures: tuple[float, ...], seeds: tuple[int, ...]) -> DataFrame:
    """Every prompt at every temperature and seed of a stated grid, each with a `call_id`."""
    temps, nums = F.array(*[F.lit(t) for t in temperatures]), F.array(*[F.lit(s) for s in seeds])
    each = prompts.select(prompt, F.explode(temps).alias("temperature")).select(prompt, "temperature", F.explode(nums).alias("seed"))
    return each.withColumn("call_id", F.md5(F.concat_ws("|", prompt, F.col("temperature").cast("string"), F.col("seed").cast("string"))))


def compare_models(prompts: DataFrame, key: str, prompt: str, client: ModelClient, models: tuple[str, ...]) -> DataFrame:
    """The answers of several models side by side and whether all are the same."""
    out = prompts.select(key, prompt)
    for m in models:
        out = out.join(call_model(prompts, key, F.col(prompt), client, m).select(key, F.col("answer").alias(m)), key)
    return out.withColumn("same", F.size(F.array_distinct(F.array(*[F.col(f"`{m}`") for m in models]))) == 1)
