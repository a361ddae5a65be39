"""Structured completions: prompts in, schema-checked answers out, each distinct prompt asked once."""

from __future__ import annotations

import hashlib
import json
import os
import re
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import patterns as P
from ..plans.skew import join_by_key
from ..plans.stage import exists, materialize


class Backend(Protocol):
    """Answers one prompt with the JSON text of one object of a type in ``schemas.TYPES``."""

    name: str

    def complete(self, system: str, user: str, kind: str) -> str: ...


EMPTY = {"result": "{}", "loan_terms": "{}", "term": '{"term":"","definition_text":""}', "fragment": '{"formula":""}'}


@dataclass
class CannedBackend:
    """Fixed answers: the first rule of the type whose marker stands in the prompt; an empty object without one."""

    rules: list[tuple[str, str, str]]  # marker, type, answer
    name: str = "canned"

    def complete(self, system: str, user: str, kind: str) -> str:
        return next((answer for marker, of, answer in self.rules if of == kind and marker in user), EMPTY[kind])


@dataclass
class DigestBackend:
    """Answers that tell prompts apart: a formula or definition is a hash of the prompt. For dry runs, without a model."""

    name: str = "digest"

    def complete(self, system: str, user: str, kind: str) -> str:
        digest = hashlib.sha256(user.encode()).hexdigest()[:12]
        made = {"fragment": {"formula": digest}, "term": {"term": digest, "definition_text": digest}}
        return json.dumps(made.get(kind, {}))


@dataclass
class PatternBackend:
    """Answers by patterns alone, for text as plain as ``The Cover Ratio shall not be less than 1.25 to 1.00``.

    A sentence with a direction and a number is a covenant, named by the capitalized words before
    ``shall``; a value of the loan terms is the first that a pattern finds. No judgement, no model.
    """

    name: str = "patterns"

    def complete(self, system: str, user: str, kind: str) -> str:
        text = user.split('"""')[1].strip("\n") if '"""' in user else user
        return json.dumps(getattr(self, "_" + kind)(text))

    @staticmethod
    def _result(text: str) -> dict:
        found = []
        for sentence in re.split(r"(?<=[.;])\s+|\n", text):
            name = re.search(r"((?:[A-Z][A-Za-z]*\s+){1,6})shall", sentence)
            upper, lower = re.search(P.UPPER_LIMIT, sentence), re.search(P.LOWER_LIMIT, sentence)
            ratio, dollars = re.search(P.RATIO, sentence), re.search(P.DOLLARS, sentence)
            if name and (upper or lower) and (ratio or dollars):
                number = float((ratio or dollars)[1].replace(",", ""))
                found.append(
                    {
                        "name": re.sub(r"^The\s+", "", name[1]).strip(),
                        "comparison": P.COMPARISONS[0 if upper else 1],
                        "threshold": number,
                        "unit": "ratio" if ratio else "USD",
                        "covenant_type": P.COVENANT_TYPES["incur" in sentence],
                        "citation": {"source_text": sentence.strip()},
                    }
                )
        return {"financial_covenants": found}

    @staticmethod
    def _loan_terms(text: str) -> dict:
        def cited(m: re.Match[str] | None) -> dict | None:
            return {"value": m[1].strip(), "citation": {"source_text": m[0].strip()}} if m else None

        party = r"((?:[A-Z][\w.&]*,?\s+){1,6}(?:LLC|Inc\.|Ltd\.|N\.A\.|Bank))"
        patterns = {
            "loan_amount": r"(\$[\d,]+(?:\.\d+)?(?: million)?)",
            "interest_rate": r"(?:rate of|bear interest at)\s+([^.;]{3,80})",
            "start_date": r"dated as of\s+([A-Z][a-z]+ \d{1,2}, \d{4})",
            "end_date": r"(?:mature on|Maturity Date (?:is|means))\s+([^.;]{3,60})",
        }
        lists = {"borrowers": re.search(party + r"[^.]{0,40}borrower", text, re.I), "lenders": re.search(party + r"[^.]{0,40}lender", text, re.I)}
        return {n: [c] if (c := cited(m)) else [] for n, m in lists.items()} | {n: cited(re.search(p, text)) for n, p in patterns.items()}

    @staticmethod
    def _term(text: str) -> dict:
        m = re.search(r'"([^"]+)"\s+(?:means|shall mean)\s*,?\s*(.*)', text, re.S)
        return {"term": m[1], "definition_text": m[2].strip()} if m else {"term": "", "definition_text": text}

    @staticmethod
    def _fragment(text: str) -> dict:
        return {"formula": " ".join(text.split())[:150]}


def json_schema(kind: str) -> dict:
    """The JSON schema of a type, from its declaration."""
    from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StructType, _parse_datatype_string

    def of(t: DataType, name: str) -> dict:
        if isinstance(t, StructType):
            item = "cited" if t.fieldNames()[:1] == ["value"] else name
            required = [p.split(".")[0] for p in schemas.REQUIRED.get(item, ())] + (["source_text"] if name == "citation" else [])
            return {"type": "object", "properties": {f.name: of(f.dataType, f.name) for f in t.fields}, "required": sorted(set(required)), "additionalProperties": False}
        if isinstance(t, ArrayType):
            return {"type": "array", "items": of(t.elementType, name)}
        if name in schemas.ENUMS:
            return {"type": "string", "enum": list(schemas.ENUMS[name])}
        return {"type": "number" if isinstance(t, DoubleType) else "integer" if isinstance(t, IntegerType) else "string"}

    return of(_parse_datatype_string(schemas.TYPES[kind]), kind)


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.loads(r.read())


@dataclass
class ChatServer:
    """A server with the chat-completions protocol and answers constrained by a JSON schema, at temperature 0."""

    url: str
    model: str
    timeout: float = 600.0
    name: str = field(init=False)

    def __post_init__(self) -> None:
        self.name = self.model

    def complete(self, system: str, user: str, kind: str) -> str:
        body = {
            "model": self.model,
            "temperature": 0,
            "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}],
            "response_format": {"type": "json_schema", "json_schema": {"name": kind, "schema": json_schema(kind), "strict": True}},
        }
        return _post(f"{self.url}/chat/completions", body, {}, self.timeout)["choices"][0]["message"]["content"]


@dataclass
class HostedModel:
    """A hosted service with the messages protocol: one tool that takes the type, which the model must use."""

    url: str
    model: str
    headers: dict[str, str] = field(default_factory=dict)
    #: The environment variable of the workers that holds the key.
    key_variable: str = "LLM_API_KEY"
    key_header: str = "x-api-key"
    max_tokens: int = 4096
    timeout: float = 600.0
    name: str = field(init=False)

    def __post_init__(self) -> None:
        self.name = self.model

    def complete(self, system: str, user: str, kind: str) -> str:
        tool = {"name": kind, "description": "Takes the answer.", "input_schema": json_schema(kind)}
        body = {
            "model": self.model,
            "max_tokens": self.max_tokens,
            "system": system,
            "messages": [{"role": "user", "content": user}],
            "tools": [tool],
            "tool_choice": {"type": "tool", "name": kind},
        }
        key = os.environ.get(self.key_variable)
        answer = _post(f"{self.url}/messages", body, {**self.headers, **({self.key_header: key} if key else {})}, self.timeout)
        return json.dumps(next(part["input"] for part in answer["content"] if part.get("type") == "tool_use"))


ANSWERS = "prompt_key string, kind string, response string, error string"


def prompt_key(backend: Backend):
    """A hash of the backend, the type and the prompts."""
    return F.sha2(F.concat_ws("\x00", F.lit(backend.name), "kind", "system", "user"), 256)


def answered(prompts: DataFrame, backend: Backend, cache: str | None = None, tasks: int | None = None) -> DataFrame:
    """``prompts(kind, system, user, ...)`` with ``response`` and ``error``; each distinct prompt is asked once.

    Answers are written before they are used, so a lost executor doesn't ask again what was answered;
    with ``cache``, a path, answers without errors are appended there and found by later calls. A
    prompt whose call fails has an error and no response. ``tasks`` bounds how many are asked at once.
    """
    spark = prompts.sparkSession
    keyed = materialize(prompts.withColumn("prompt_key", prompt_key(backend)), "prompts")
    wanted = keyed.select("prompt_key", "kind", "system", "user").dropDuplicates(["prompt_key"])
    known = spark.read.schema(ANSWERS).parquet(cache) if cache and exists(spark, cache) else None
    if known is not None:
        wanted = wanted.join(known.select("prompt_key"), "prompt_key", "left_anti")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, kind, system, user in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows.append((key, kind, backend.complete(system, user, kind), None))
                except Exception as e:  # whatever a backend raises becomes the row's error
                    rows.append((key, kind, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["prompt_key", "kind", "response", "error"])

    dealt = wanted.repartition(tasks, "prompt_key") if tasks else wanted
    new = materialize(dealt.mapInArrow(ask, ANSWERS), "answers")
    if cache:
        new.where("error IS NULL").write.mode("append").parquet(cache)
    every = new if known is None else new.unionByName(spark.read.schema(ANSWERS).parquet(cache).dropDuplicates(["prompt_key"]).join(new.select("prompt_key"), "prompt_key", "left_anti"))
    found = materialize(every.select("prompt_key", "response", "error"), "known-answers") if known is not None else every.select("prompt_key", "response", "error")
    return join_by_key(keyed, found, ["prompt_key"], ["user", *[c for c in prompts.columns if c in ("doc_id", "rank")]]).drop("prompt_key")


def completed(prompts: DataFrame, backend: Backend, kind: str, cache: str | None = None) -> DataFrame:
    """``answered`` prompts of one type with ``value`` and ``fault``: the checked answer, or why there's none."""
    found = schemas.parsed(answered(prompts.withColumn("kind", F.lit(kind)), backend, cache), kind)
    return found.withColumn("fault", F.coalesce("error", "fault")).drop("kind", "system", "user", "response", "error")
