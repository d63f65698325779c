"""String functions of question answering, file names and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def answer_is_correct(prediction: Column, answer: Column, options: Column | None = None) -> Column:
    """The last character is the answer, or the text is "<letter>. <option text>" of the answer's option."""
    p, a = F.trim(prediction), F.trim(answer)
    last = F.coalesce((p != "") & (F.substring(p, -1, 1) == a), F.lit(False))
    if options is None:
        return last
    bare = lambda c: F.btrim(c, F.lit("."))
    matched = F.filter(F.map_entries(options), lambda e: F.concat(e["key"], F.lit(". "), bare(e["value"])) == bare(p))
    return last | F.coalesce((p != "") & (F.get(matched, F.lit(0))["key"] == a), F.lit(False))


def name_prefix(name: Column) -> Column:
    return F.split_part(name, F.lit("_"), F.lit(1))


def reid_fields(name: Column) -> Column:
    """pid and camera of a file name `<pid>_c<cam>...`; null where it isn't one."""
    part = lambda k: F.nullif(F.regexp_extract(name, r"([-\d]+)_c(\d+)", k), F.lit("")).try_cast("int")
    return F.struct(part(1).alias("pid"), part(2).alias("camid"))


def sample_stem(path: Column) -> Column:
    """Parts of a relative path joined by __, without the suffix and without a leading train or test."""
    bare = F.regexp_replace(path, r"\.[^./]*$", "")
    return F.replace(F.regexp_replace(bare, r"^(train|test)/", ""), F.lit("/"), F.lit("__"))


def prompt(question: Column, options: Column, suffix: str = "") -> Column:
    """The question without lines that begin with Hint:, then one line for each option, then the suffix."""
    lines = F.filter(F.split(question, "\n"), lambda line: ~F.startswith(F.ltrim(line), F.lit("Hint:")))
    choices = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"]))
    return F.concat_ws("\n", F.array_join(lines, "\n"), F.array_join(choices, "\n"), F.lit(suffix or None))
