"""Tokens, paths and mined text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def action_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<action_"), i.cast("string"), F.lit(">"))), "")


def action_ids(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"<action_(\d+)>")), lambda x: x.cast("int"))


def frame_token(base: Column, number: Column, width: int = 3) -> Column:
    return F.concat(base, F.lit("-"), F.lpad(number.cast("string"), width, "0"))


def token_base(token: Column) -> Column:
    return F.regexp_extract(token, r"^(.*)-(\d+)$", 1)


def token_number(token: Column) -> Column:
    return F.try_to_number(F.regexp_extract(token, r"^(.*)-(\d+)$", 2), F.lit("999999999")).cast("int")


def path_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def path_part(path: Column, k: int) -> Column:
    """k-th component from the end, from -1."""
    return F.try_element_at(F.split(path, "/"), F.lit(k))


def first_sentence(text: Column) -> Column:
    return F.lower(F.split(text, r"\.")[0])


def marked_names(text: Column) -> Column:
    """What stands in angle brackets."""
    return F.regexp_extract_all(text, F.lit("<([^>]+)>"))


def replace_marked(text: Column, names: Column) -> Column:
    """Each <id> replaced by the map's text for it; unknown ones stay."""
    return F.aggregate(marked_names(text), text, lambda t, k: F.replace(t, F.concat(F.lit("<"), k, F.lit(">")), F.coalesce(F.try_element_at(names, k), F.concat(F.lit("<"), k, F.lit(">")))))


def state_sentence(speed: Column, acceleration: Column) -> Column:
    return F.format_string("The current speed is %.3f m/s and the acceleration is %.3f m/s^2.", speed, acceleration)


def chat_answer(dataset: Column, reasoning: Column, action: Column) -> Column:
    """Reasoning before the action where there is any; one dataset counts an empty reasoning as none."""
    has = reasoning.isNotNull() & ((dataset != "nuscenes") | (reasoning != ""))
    thought = F.when(has, F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>\n"))).otherwise("<think>\nThis is a simple scene.\n</think>\n")
    return F.concat(thought, F.lit("<answer>\n"), action, F.lit("\n</answer>"))
