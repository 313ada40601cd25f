"""Text functions on columns, with Unicode white space and code-point positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that count as white space; one spelling that Java and RE2 both read.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same code points one by one.
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LOOP_SHORTEST, LOOP_LONGEST = 2, 32
# The texts that the chat markup puts around messages.
DEFAULT_SYSTEM = "You are a helpful assistant"
NO_THOUGHT = "<think>\n\n</think>\n\n"
TOOLS_LEAD = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_TAIL = "\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{\"name\": <function-name>, \"arguments\": <args-json-object>}\n</tool_call>"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def trimmed(c: Column) -> Column:
    """``strip`` without a regular expression that looks at every place, for what is done many times a row; bytes that are no UTF-8 stay."""
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, WS, "")


def chars(c: Column) -> Column:
    """Code points as an array."""
    return F.filter(F.split(c, "", -1), lambda x: x != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once a row; inside lambdas an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(items: Column, n: int, window: Callable[[Column, Column], Column]) -> Column:
    count = F.size(items) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: window(items, i))
    return F.when(items.isNull(), None).when(count < 1, F.lit(0.0)).otherwise((count - F.size(F.array_distinct(grams))) / count)


def repetition(items: Column, n: int = 4) -> Column:
    """Share of the windows of n items that occurred before; 0 for fewer than n items, null for null."""
    return let(items, lambda x: _repeated(x, n, lambda y, i: F.slice(y, i, F.lit(n))))


def char_repetition(c: Column, n: int = 4) -> Column:
    """``repetition`` of the code points besides white space; windows are the strings that stand ahead of every place."""
    grams = F.regexp_extract_all(squeeze(c), F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))
    return let(grams, lambda g: F.when(F.size(g) > 0, (F.size(g) - F.size(F.array_distinct(g))) / F.size(g)).when(g.isNotNull(), F.lit(0.0)))


def has_loop(c: Column) -> Column:
    """Whether a unit of 2 to 32 code points stands three times in a row, white space aside."""
    return squeeze(c).rlike(rf"(?s)(.{{{LOOP_SHORTEST},{LOOP_LONGEST}}})\1\1")


def occurrences(c: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.regexp_count(c, F.lit(r"\Q" + literal + r"\E")).cast("long")


def template(c: Column, attributes: Column) -> Column:
    """The text with each attribute value replaced by its name in braces (longest values first), numbers and blanks folded."""
    order = F.array_sort(F.transform(attributes, lambda a, i: F.struct((-F.length(a["value"])).alias("l"), i.alias("i"), a["key"].alias("k"), a["value"].alias("v"))))
    named = F.aggregate(order, c, lambda t, a: F.when(a["v"] == "", t).otherwise(F.replace(t, a["v"], F.concat(F.lit("{"), a["k"], F.lit("}")))))
    return squeeze(F.regexp_replace(named, r"(?U)\d+(?:\.\d+)?", "{数值}"))


def conversation_key(messages: Column) -> Column:
    """Identity of a conversation: SHA-256 of its stripped contents joined by NUL, whatever the roles."""
    return F.sha2(F.array_join(F.transform(messages, lambda m: strip(m["content"])), "\0"), 256)


def render_chat(messages: Column, generate: bool = False) -> Column:
    turns = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(turns, F.lit("<|im_start|>assistant\n")) if generate else turns


def _turn(role: Column | str, body: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.lit(role) if isinstance(role, str) else role, F.lit("\n"), body, F.lit("<|im_end|>\n"))


def _calls(calls: Column, content: Column) -> Column:
    """Tool calls, array<struct<name, arguments>> with arguments as JSON, one a line below the content."""
    one = lambda c: F.concat(F.lit('<tool_call>\n{"name": "'), c["name"], F.lit('", "arguments": '), c["arguments"], F.lit("}\n</tool_call>"))
    joined = F.array_join(F.transform(calls, one), "\n")
    return F.when(F.coalesce(F.size(calls), F.lit(0)) < 1, "").when(content == "", joined).otherwise(F.concat(F.lit("\n"), joined))


def chat_prompt(messages: Column, generate: bool = False, thinking: bool = True, tools: Column | None = None, calls: bool = False) -> Column:
    """A conversation by the rules of the model's chat template.

    A system turn comes first: the first message if it is one, else DEFAULT_SYSTEM. With ``tools`` (array of JSON
    strings, not empty) that turn lists them, and has no default. Neighbouring tool messages share one user turn; with
    ``calls`` messages have ``tool_calls``. Null contents are empty, other roles leave no turn. ``generate`` opens the
    assistant's turn, with an empty thought unless ``thinking``. Null for null.
    """
    first = F.get(messages, F.lit(0))
    own = F.when(first["role"] == "system", F.coalesce(first["content"], F.lit("")))
    head = F.coalesce(own, F.lit(DEFAULT_SYSTEM))
    if tools is not None:
        listed = F.concat(F.lit(TOOLS_LEAD), F.concat_ws("", F.transform(tools, lambda t: F.concat(F.lit("\n"), t))), F.lit(TOOLS_TAIL))
        head = F.when(F.size(tools) > 0, F.concat(F.coalesce(F.concat(own, F.lit("\n\n")), F.lit("")), listed)).otherwise(head)

    def turn(m: Column, i: Column) -> Column:
        text = F.coalesce(m["content"], F.lit(""))
        is_tool = lambda at: F.coalesce(F.get(messages, at)["role"] == "tool", F.lit(False))
        opened = F.when(is_tool(i - 1), "").otherwise("<|im_start|>user")
        closed = F.when(is_tool(i + 1), "").otherwise("<|im_end|>\n")
        said = F.concat(text, _calls(m["tool_calls"], text)) if calls else text
        return (
            F.when((m["role"] == "user") | ((m["role"] == "system") & (i > 0)), _turn(m["role"], text))
            .when(m["role"] == "assistant", _turn("assistant", said))
            .when(m["role"] == "tool", F.concat(opened, F.lit("\n<tool_response>\n"), text, F.lit("\n</tool_response>"), closed))
            .otherwise("")
        )

    opening = "<|im_start|>assistant\n" + ("" if thinking else NO_THOUGHT) if generate else ""
    return F.when(messages.isNotNull(), F.concat(_turn("system", head), F.array_join(F.transform(messages, turn), ""), F.lit(opening)))


def parse_chat(c: Column) -> Column:
    """Messages of rendered chat markup, contents stripped."""
    pattern = F.lit(rf"(?s)<\|im_start\|>(system|user|assistant){WS}+(.*?)<\|im_end\|>")
    pairs = F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("role"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("content"))
    return F.transform(pairs, lambda m: F.struct(m["role"].alias("role"), strip(m["content"]).alias("content")))
