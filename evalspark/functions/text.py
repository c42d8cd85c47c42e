"""Column functions for prompt text and answer extraction.

All of these are built-in Spark expressions: they stay in whole-stage codegen
and never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark import constants as K

# Python's str.strip() removes every Unicode whitespace character, plus the
# four ASCII separators 0x1c-0x1f; Spark's trim() only removes spaces.
_WS = r"[\s\x1c-\x1f]"
_STRIP_RX = rf"(?U)^{_WS}+|{_WS}+$"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Strip leading/trailing Unicode whitespace, like Python's ``str.strip``."""
    return F.regexp_replace(col_of(c), _STRIP_RX, "")


def as_text(c: Column | str) -> Column:
    """Render a value the way an f-string would: strings as-is, null as 'None'."""
    return F.coalesce(col_of(c).cast("string"), F.lit("None"))


def format_prompt(instruction: Column | str, input_text: Column | str | None = None) -> Column:
    """The instruction-following wrapper; the input section only when non-empty."""
    ins = col_of(instruction)
    no_input = F.concat(
        F.lit(K.PROMPT_NO_INPUT_HEAD + K.PROMPT_INSTRUCTION), ins,
        F.lit("\n\n" + K.PROMPT_RESPONSE),
    )
    if input_text is None:
        return no_input
    inp = F.coalesce(col_of(input_text), F.lit(""))
    with_input = F.concat(
        F.lit(K.PROMPT_WITH_INPUT_HEAD + K.PROMPT_INSTRUCTION), ins,
        F.lit("\n\n" + K.PROMPT_INPUT), inp,
        F.lit("\n\n" + K.PROMPT_RESPONSE),
    )
    return F.when(inp != "", with_input).otherwise(no_input)


def training_prompt(instruction, input_text, output) -> Column:
    """Wrapper plus the gold output."""
    return F.concat(format_prompt(instruction, input_text), F.coalesce(col_of(output), F.lit("")))


def user_prompt(instruction, input_text) -> Column:
    """Wrapper without the output."""
    return format_prompt(instruction, input_text)


def eval_prompt(instruction) -> Column:
    """C4: wrapper around an evaluation instruction (no input section)."""
    return format_prompt(instruction)


def extract_prediction(task: Column | str, text: Column | str,
                       patterns: Mapping[str, str] = K.ANSWER_PATTERNS) -> Column:
    """First whole-word match of the task's pattern in the stripped,
    lower-cased text, else ''. An unknown task raises.

    One ``regexp_extract`` per *distinct* pattern keeps each regex a constant
    (compiled once per task, not per row).
    """
    normalized = F.lower(py_strip(text))
    task_c = col_of(task)
    by_pattern: dict[str, list[str]] = {}
    for name, rx in patterns.items():
        by_pattern.setdefault(rx, []).append(name)
    expr = None
    for rx, names in by_pattern.items():
        branch = F.regexp_extract(normalized, "(?U)" + rx, 1)
        cond = task_c.isin(*names)
        expr = F.when(cond, branch) if expr is None else expr.when(cond, branch)
    unknown = F.raise_error(F.concat(F.lit("Unsupported task for extraction: "), as_text(task_c)))
    return expr.otherwise(unknown.cast("string"))


def label_to_index(key: Column | str, mapping: Mapping[str, int] = K.ANSWER_KEY_INDEX) -> Column:
    """Answer key (A-E or 1-5) to a 1-based index; anything else raises."""
    k = col_of(key).cast("string")
    expr = None
    for label, idx in mapping.items():
        expr = F.when(k == label, F.lit(idx)) if expr is None else expr.when(k == label, F.lit(idx))
    bad = F.raise_error(F.concat(F.lit("Unknown answer key: "), as_text(k)))
    return expr.otherwise(bad.cast("int"))
