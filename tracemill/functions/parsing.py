"""Tool calls, final answers and turns out of generated text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .trace import CALL, bind

_N = r"-?\d+(?:\.\d+)?"
#: Decimal digits of all scripts and the ASCII digits that they stand for.
_DIGITS = [c for c in map(chr, range(0x660, 0x110000)) if unicodedata.decimal(c, None) is not None]
_ASCII = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)
#: The forms of a final answer, in the order in which they are tried. Digits and blanks are those of Unicode.
ANSWERS = (
    rf"(?iU)(?:the\s+)?answer\s+is\s*[:=]?\s*\$?\s*({_N})\s*\$?",
    rf"(?isU)(?:the\s+)?(?:final\s+)?result(?:\s+of.*?)?\s+is\s*[:=]?\s*\$?\s*({_N})\s*\$?",
    rf"(?U)\\boxed\{{\s*({_N})\s*\}}",
    rf"(?iU)final(?:\s+answer)?\s*[:=]\s*\$?\s*({_N})\s*\$?",
    rf"(?U)^\s*\$?\s*({_N})\s*\$?\s*\.?\s*$",
)
#: Labels of parse errors by dialect; None leaves the error out of the dialect.
LABELS = {
    "standard": {
        "unclosed": "unclosed_tool_call", "multiple": "multiple_tool_calls_in_one_turn", "malformed": "malformed_tool_call", "name": "wrong_tool_name",
        "keys": "wrong_argument_schema", "operator": "invalid_operator", "operand": "non_numeric_operand",
    },
    "quantized": {
        "unclosed": "unclosed_tool_call", "multiple": "multiple_tool_calls", "malformed": "malformed_tool_call", "name": "wrong_tool_name",
        "keys": "wrong_schema", "operator": "invalid_operator", "operand": "non_numeric",
    },
    "integer": {
        "unclosed": "unclosed_tool_call", "multiple": "multiple_tool_calls_in_one_turn", "malformed": "malformed_tool_call", "name": "wrong_tool_name",
        "keys": "wrong_argument_schema", "operator": "invalid_operator", "operand": "non_integer_operand",
    },
}
_CALL = r"(?sU)<tool_call>\s*(.*?)\s*</tool_call>"


def final_answer(text: Column) -> Column:
    """The last match of the first form that matches at all, as a number; null if none does."""
    found = F.coalesce(*(F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(-1)) for p in ANSWERS))
    return F.translate(found, "".join(_DIGITS), _ASCII).try_cast("double")


#: The text as the first of two fields; the second is missed if the text closes more than it opens.
_WRAPPED = "x struct<name: variant, arguments: map<string, variant>>, z int, corrupt string"
_OPTIONS = {"columnNameOfCorruptRecord": "corrupt", "allowSingleQuotes": "false"}
_KIND = f"struct<call: {CALL}, error: string>"


def _outcome(error: Column, call: Column | None = None) -> Column:
    return F.struct((F.lit(None) if call is None else call).cast(CALL).alias("call"), error.cast("string").alias("error")).cast(_KIND)


def _nested(kind: Column) -> Column:
    return kind.startswith("ARRAY") | kind.startswith("OBJECT")


def _of_object(x: Column, tool: str, label: dict[str, str], integer: bool) -> Column:
    """The outcome for a record whose arguments are an object; of repeated keys the last counts."""
    last = lambda key: F.try_element_at(F.filter(F.map_entries(x["arguments"]), lambda e: e["key"] == key), F.lit(-1))["value"]
    parts = F.struct(
        F.schema_of_variant(x["name"]).alias("name_kind"), F.try_variant_get(x["name"], "$", "string").alias("name"),
        F.array_sort(F.array_distinct(F.map_keys(x["arguments"]))).alias("keys"), F.try_variant_get(last("op"), "$", "string").alias("op"),
        F.schema_of_variant(last("op")).alias("op_kind"), *(F.schema_of_variant(last(c)).alias(f"{c}_kind") for c in "ab"),
        *(F.try_variant_get(last(c), "$", "double").alias(c) for c in "ab"),
    )
    # Whole numbers beyond 64 bits come as decimals of 19 digits or more.
    number = "^(BIGINT|DECIMAL[(](19|[23][0-9]),0[)])$" if integer else "^(BIGINT|DOUBLE|DECIMAL.*)$"
    no = lambda c: ~F.coalesce(c, F.lit(False))

    def judged(p: Column) -> Column:
        error = (
            F.when(p["name_kind"].isNull(), label["malformed"]).when(no((p["name_kind"] == "STRING") & (p["name"] == tool)), label["name"])
            .when(no(p["keys"] == F.array(F.lit("a"), F.lit("b"), F.lit("op"))), label["keys"]).when(_nested(p["op_kind"]), label["malformed"])
            .when(no((p["op_kind"] == "STRING") & p["op"].isin("+", "-", "*")), label["operator"])
            .when(no(p["a_kind"].rlike(number) & p["b_kind"].rlike(number)), label["operand"])
        )
        return bind(error, lambda e: _outcome(e, F.when(e.isNull(), F.struct(*(p[c].alias(c) for c in ("op", "a", "b"))))))

    return bind(parts, judged)


def _of_other(json: Column, tool: str, label: dict[str, str]) -> Column:
    """The outcome where the text is no JSON or its arguments are no object."""
    part = lambda v, path, kind="variant": F.try_variant_get(v, path, kind)

    def judged(v: Column) -> Column:
        elements = F.transform(part(v, "$.x.arguments", "array<variant>"), lambda y: F.struct(F.schema_of_variant(y).alias("k"), F.try_variant_get(y, "$", "string").alias("s")))
        kind, name = F.schema_of_variant(part(v, "$.x.arguments")), part(v, "$.x.name")
        names = F.array_sort(F.array_distinct(F.transform(elements, lambda e: F.when(e["k"] == "STRING", e["s"]).otherwise("?"))))
        hashless = F.exists(elements, lambda e: _nested(e["k"])) | (names == F.array(F.lit("a"), F.lit("b"), F.lit("op")))
        error = (
            F.when(v.isNull() | F.try_variant_get(v, "$.z", "int").isNull() | kind.isNull() | name.isNull(), label["malformed"])
            .when(~F.coalesce((F.schema_of_variant(name) == "STRING") & (F.try_variant_get(name, "$", "string") == tool), F.lit(False)), label["name"])
            .when(kind == "STRING", label["keys"]).when(kind.startswith("ARRAY") & ~F.coalesce(hashless, F.lit(False)), label["keys"]).otherwise(label["malformed"])
        )
        return _outcome(error)

    return bind(F.try_parse_json(json), judged)


def tool_call(text: Column, tool: str = "calculator", dialect: str = "standard") -> Column:
    """struct<call: struct<op, a, b>, error>: the one tool call of a text, or what is wrong with it; both null without any.

    Checks come in a fixed order: tags, number of calls, JSON, arguments present, tool, keys, operator, operands.
    Booleans and strings are no numbers, whatever they hold; NaN and infinities are. Of repeated keys the last counts.
    A list or object as operator, and arguments that are a number, a truth value, null or a list of the three names,
    are malformed; a text or any other list as arguments has wrong keys. One match and one parse for each text.
    """
    label = LABELS[dialect]

    def of_one(json: Column) -> Column:
        whole = lambda r: F.when(r["corrupt"].isNull() & (r["z"] == 0) & r["x"]["arguments"].isNotNull(), _of_object(r["x"], tool, label, dialect == "integer")).otherwise(_of_other(json, tool, label))
        return bind(F.from_json(json, _WRAPPED, _OPTIONS), whole)

    def of(t: Column) -> Column:
        def counted(found: Column) -> Column:
            none = F.when(F.contains(t, F.lit("<tool_call>")), label["unclosed"])
            one = bind(F.concat(F.lit('{"x": '), F.get(found, F.lit(0)), F.lit(', "z": 0}')), of_one)
            return F.when(F.size(found) == 1, one).when(F.size(found) > 1, _outcome(F.lit(label["multiple"]))).otherwise(_outcome(none))

        return bind(F.regexp_extract_all(t, F.lit(_CALL), F.lit(1)), counted)

    return bind(text, of)


def first_call_only(text: Column) -> Column:
    """The text up to the end of its first closing tag, all of it without one."""
    end = F.instr(text, "</tool_call>")
    return F.when(end > 0, F.substring(text, F.lit(1), end + F.lit(len("</tool_call>") - 1))).otherwise(text)


def before_call(text: Column) -> Column:
    """What stands before the first opening tag, trimmed."""
    return F.trim(F.split_part(text, F.lit("<tool_call>"), F.lit(1)))


def generated_count(ids: Column, end_id: int, has_call: Column) -> Column:
    """Generated tokens: up to the first end id, which counts unless the turn holds a tool call; all without one."""
    at = F.array_position(ids, end_id)
    return F.when(at == 0, F.size(ids).cast("long")).otherwise(at - 1 + F.when(has_call, 0).otherwise(1))


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text, without overlaps; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(F.lit(0).cast("long"))


def play(turns: Column, budget: int | Column, dialect: str = "standard") -> Column:
    """struct<calls, answer, error, turns_used, done> of an agent's turns up to the one that ends the play.

    turns: array<struct<text, exhausted>>; exhausted says that the turn ran out of tokens. A turn ends the play by
    exhaustion without a closed call, by a parse error, by an answer or the lack of one, or by a call beyond the
    budget. When the turns run out first the error is agent_loop_exhausted.
    """
    def read(t: Column, at: Column) -> Column:
        """What a turn comes to, and whether the play ends with it; all turns before the last have one call each."""
        ended = lambda answer, error: F.struct(
            F.lit(None).cast(CALL).alias("call"), answer.cast("double").alias("answer"), error.cast("string").alias("error"), F.lit(True).alias("ended")
        )
        none = F.lit(None)

        def judged(text: Column, p: Column) -> Column:
            answered = bind(final_answer(text), lambda a: ended(a, F.when(a.isNull(), "missing_final_answer")))
            went = F.struct(p["call"].alias("call"), none.cast("double").alias("answer"), none.cast("string").alias("error"), F.lit(False).alias("ended"))
            return (
                F.when(p["error"].isNotNull(), ended(none, p["error"])).when(p["call"].isNull(), answered)
                .when(at >= budget, ended(none, F.lit("max_tool_calls_exceeded"))).otherwise(went)
            )

        parsed = bind(first_call_only(F.trim(t["text"])), lambda text: bind(tool_call(text, dialect=dialect), lambda p: judged(text, p)))
        return F.when(t["exhausted"] & ~F.contains(t["text"], F.lit("</tool_call>")), ended(none, F.lit("thinking_budget_exhausted"))).otherwise(parsed)

    def told(r: Column) -> Column:
        end = F.array_position(F.transform(r, lambda x: x["ended"]), True).cast("int")
        return bind(end, lambda e: F.struct(
            F.transform(F.slice(r, F.lit(1), F.when(e > 0, e - 1).otherwise(F.size(r))), lambda x: x["call"]).alias("calls"),
            F.when(e > 0, F.get(r, e - 1)["answer"]).alias("answer"), F.when(e > 0, F.get(r, e - 1)["error"]).otherwise("agent_loop_exhausted").alias("error"),
            F.when(e > 0, e).otherwise(F.size(r)).alias("turns_used"), (e > 0).alias("done"),
        ))

    return F.when(turns.isNotNull(), bind(F.transform(turns, read), told))
