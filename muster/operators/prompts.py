"""Projections of rows to text: descriptions for prompts, records, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..plans.dictionary import Dictionary


def goes_to(usage: str, target: str) -> bool:
    """store_only goes nowhere, both everywhere."""
    return usage != "store_only" and usage in ("both", target)


def _shown(p: dict, kinds: dict[str, str]) -> Column:
    column = F.col(p["key"])
    kind = kinds[p["key"]]
    return rules.rendered(column.cast("double") if kind == rules.NUMBER else column, kind)


def block(d: Dictionary, target: str = "text", mention: str = "natural") -> Column:
    """Lines `title: value` under [group] headings in order of first appearance; absent values are left out of texts only."""
    kinds, grouped = d.kinds(), {}
    for p in d.params:
        if goes_to(p.get("usage", "both"), target) and (target != "text" or p.get("mention", "natural") == mention):
            line = F.concat(F.lit(f"{p.get('title', p['key'])}: "), _shown(p, kinds))
            gone = rules.absent(F.col(p["key"]), kinds[p["key"]]) if target == "text" else F.col(p["key"]).isNull()
            grouped.setdefault(p.get("group", ""), []).append(F.when(~gone, line))
    parts = []
    for name, lines in grouped.items():
        body = F.concat_ws("\n", *lines)
        parts.append(F.when(body != "", F.concat(F.lit(f"[{name}]\n"), body) if name else body))
    return F.concat_ws("\n", *parts)


def background(d: Dictionary) -> Column:
    """Lines `— directive: value` of what is to show without being said."""
    kinds = d.kinds()
    lines = [F.when(~rules.absent(F.col(p["key"]), kinds[p["key"]]), F.concat(F.lit(f"— {p.get('directive', p.get('title', p['key']))}: "), _shown(p, kinds))) for p in d.params if p.get("mention") == "background"]
    return F.concat_ws("\n", *lines)


def required(d: Dictionary) -> Column:
    """`title: value` of what must be said, null values left out."""
    kinds = d.kinds()
    return F.array_compact(F.array(*[F.when(F.col(p["key"]).isNotNull(), F.concat(F.lit(f"{p.get('title', p['key'])}: "), _shown(p, kinds))) for p in d.params if p.get("mention") == "required"]).cast("array<string>"))


def request(d: Dictionary, brief: str, schema: str, max_tokens: int = 2000) -> Column:
    """The body of a request for a text, as JSON."""
    user = F.concat_ws("\n\n", block(d), F.nullif(background(d), F.lit("")), F.when(F.size(required(d)) > 0, F.array_join(required(d), "\n")), F.nullif(F.lit(brief), F.lit("")))
    return F.to_json(F.struct(F.lit(0.9).alias("temperature"), F.lit(max_tokens).alias("max_tokens"), user.alias("user"), F.lit(schema).alias("schema")))


def model_request(model: str, system: str, user: Column, schema: str | None = None, max_tokens: int | None = None, temperature: float | None = None, effort: str = "low", supports_schema: bool = False, supports_effort: bool = False) -> Column:
    """The body of a call to a chat model. A model that keeps no schema is asked for an object; an effort is stated only where it is known and not low."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    parts = [F.lit(model).alias("model"), F.array(said("system", F.lit(system)), said("user", user)).alias("messages")]
    parts += [F.lit(max_tokens).alias("max_tokens")] * (max_tokens is not None) + [F.lit(temperature).alias("temperature")] * (temperature is not None)
    parts += [F.lit(effort).alias("reasoning_effort")] * (supports_effort and effort != "low")
    body = F.to_json(F.struct(*parts))
    if schema is None:
        return body
    form = f'{{"type":"json_schema","json_schema":{{"name":"result","strict":true,"schema":{schema}}}}}' if supports_schema else '{"type":"json_object"}'
    return F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"response_format":' + form + "}"))


def model_response(body: Column, price_in: Column, price_out: Column) -> Column:
    """(text, tokens_in, tokens_out, cost) of a chat model's answer: its first choice, empty where there is none; prices are per million tokens."""
    n = lambda path: F.coalesce(F.get_json_object(body, path).cast("long"), F.lit(0))
    tin, tout = n("$.usage.prompt_tokens"), n("$.usage.completion_tokens")
    return F.struct(F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), F.lit("")).alias("text"), tin.alias("tokens_in"), tout.alias("tokens_out"), (tin / 1e6 * price_in + tout / 1e6 * price_out).alias("cost"))


def image_requests(df: DataFrame, d: Dictionary, roles: list[tuple[str, str, str | None]]) -> DataFrame:
    """A row for each role (role, style, role it builds on) of each row."""
    wanted = F.array(*[F.struct(F.lit(r).alias("role"), F.concat_ws("\n", F.lit(style), block(d, "visual")).alias("prompt"), F.lit(ref).cast("string").alias("ref_role")) for r, style, ref in roles])
    return df.withColumn("_r", F.explode(wanted)).select(*df.columns, "_r.*")


def variant(key: Column, salt: str, choices: list[str]) -> Column:
    """One of the choices, always the same for a key."""
    n = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), key).cast("binary")), 1, 8), 16, 10).cast("long") % len(choices)
    return F.element_at(F.array(*map(F.lit, choices)), (n + 1).cast("int"))


def record(df: DataFrame, kind: str, texts: list[str], echoes: list[str] = ()) -> Column:
    """A row with its accepted texts as JSON without nulls and echoed fields."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in echoes and c not in texts], *[F.col(t) for t in texts], F.lit(kind).alias("entity_kind")))


def restored(df: DataFrame, d: Dictionary, column: str) -> DataFrame:
    """Rows out of records; fields that are no parameters are left."""
    return df.withColumn("_r", F.from_json(column, d.schema())).select("_r.*")


def transcript(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, a line `role: text` each."""
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).select("conv_id", F.size("t").alias("n_turns"), F.array_join(F.transform("t", lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n").alias("transcript"))
