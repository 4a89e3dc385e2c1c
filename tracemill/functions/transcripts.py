"""Transcripts: arrays of role-tagged messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas
from .expressions import number_text

WORDING = {
    "precedence": ["Multiplication binds first.", "The product comes before the sum.", "Take the factors together."],
    "combine": ["Now the terms from the left.", "Only sums are left.", "Add up what remains."],
}


def prompt(messages: Column) -> Column:
    """The first two messages."""
    return F.slice(messages, 1, 2)


def expected_calls(messages: Column) -> Column:
    """The arguments of the first call of every assistant message that has calls, in order."""
    calling = F.filter(messages, lambda m: (m["role"] == "assistant") & m["tool_calls"].isNotNull())
    return F.transform(calling, lambda m: F.get(m["tool_calls"], F.lit(0))["function"]["arguments"])


def observations(messages: Column) -> Column:
    return F.transform(F.filter(messages, lambda m: m["role"] == "tool"), lambda m: m["content"])


def final_text(messages: Column) -> Column:
    """The last assistant message without calls; an error if there is none."""
    found = F.try_element_at(F.filter(messages, lambda m: (m["role"] == "assistant") & m["tool_calls"].isNull()), F.lit(-1))
    return F.when(found.isNull(), F.raise_error(F.lit("no final assistant message")).cast("string")).otherwise(found["content"])


def last_assistant(messages: Column) -> Column:
    """The last assistant message of any kind, empty if there is none."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))["content"], F.lit(""))


def prompt_completion(messages: Column) -> Column:
    """struct<prompt, completion>: the messages before the last one of the assistant, and that one; null without any. What follows it goes."""
    last = F.size(messages) - F.array_position(F.reverse(F.transform(messages, lambda m: m["role"] == "assistant")), True).cast("int") + 1
    cut = F.struct(F.slice(messages, F.lit(1), last - 1).alias("prompt"), F.slice(messages, last, F.lit(1)).alias("completion"))
    return F.when(F.exists(messages, lambda m: m["role"] == "assistant"), cut)


#: Fixed value: the label of a token that no loss is taken of.
IGNORED = -100


def assistant_labels(messages: Column) -> Column:
    """struct<input_ids, labels> of messages with their token ids: a token's label is the token after it if the assistant wrote that one."""
    own = F.flatten(F.transform(messages, lambda m: F.transform(m["ids"], lambda x: F.when(m["role"] == "assistant", x).otherwise(IGNORED))))
    labels = F.when(F.size(own) > 0, F.concat(F.slice(own, F.lit(2), F.size(own)), F.array(F.lit(IGNORED)))).otherwise(own)
    return F.struct(F.flatten(F.transform(messages, lambda m: m["ids"])).alias("input_ids"), labels.alias("labels"))


def parts_text(parts: Column) -> Column:
    """Text of a message that comes as a list of parts."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")


def result_json(value: Column) -> Column:
    """A tool result as JSON, whole numbers without a fraction."""
    return F.concat(F.lit('{"result": '), number_text(value), F.lit("}"))


def read_result(content: Column) -> Column:
    return F.get_json_object(content, "$.result").try_cast("double")


def wording(stage: Column, key: Column) -> Column:
    """A sentence for a step, chosen by hash."""
    pick = lambda s: F.element_at(F.array(*map(F.lit, WORDING[s])), (F.pmod(key, F.lit(len(WORDING[s]))) + 1).cast("int"))
    return F.when(stage == "precedence", pick("precedence")).otherwise(pick("combine"))


def build(system: Column, expression: Column, steps: Column, answer: Column, key: Column) -> Column:
    """The transcript of a trace: system and user message, a call and its result for every step, the answer."""
    kind, null = schemas.MESSAGE, F.lit(None).cast("string")
    no_calls = F.lit(None).cast(f"array<struct<id: string, type: string, function: struct<name: string, arguments: {schemas.CALL}>>>")
    message = lambda role, content, calls=no_calls, name=null, call_id=null: F.struct(
        F.lit(role).alias("role"), content.alias("content"), calls.alias("tool_calls"), name.alias("name"), call_id.alias("tool_call_id")
    ).cast(kind)

    def step(s: Column, i: Column) -> Column:
        call_id = F.concat(F.lit("call_"), F.lpad((i + 1).cast("string"), 2, "0"))
        arguments = F.struct(s["op"].alias("op"), s["a"].alias("a"), s["b"].alias("b"))
        call = F.struct(call_id.alias("id"), F.lit("function").alias("type"), F.struct(F.lit("calculator").alias("name"), arguments.alias("arguments")).alias("function"))
        return F.array(
            message("assistant", wording(s["stage"], key + i), F.array(call)), message("tool", result_json(s["result"]), name=F.lit("calculator"), call_id=call_id)
        )

    user = F.concat(F.lit("Work out "), expression, F.lit("."))
    end = F.concat(F.lit("The answer is "), number_text(answer), F.lit("."))
    return F.concat(F.array(message("system", system), message("user", user)), F.flatten(F.transform(steps, step)), F.array(message("assistant", end)))
