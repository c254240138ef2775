"""Text helpers of retrieval pipelines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_count(text: Column) -> Column:
    """Number of parts between white space; 0 for null or blank."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"\s+")))


def context_tokens(texts: Column) -> Column:
    """Tokens of an array of texts."""
    return F.aggregate(texts, F.lit(0), lambda n, t: n + token_count(t))


def prompt(system: Column, question: Column, contexts: Column) -> Column:
    """System prompt, question, contexts (structs of id and text) and a closing cue; blank lines between the parts."""
    shown = F.transform(contexts, lambda c: F.concat(F.lit("["), c["id"].cast("string"), F.lit("] "), c["text"]))
    opening = F.array(system, F.lit(""), F.concat(F.lit("Question: "), question), F.lit(""), F.lit("Contexts:"))
    return F.array_join(F.concat(opening, shown, F.array(F.lit(""), F.lit("Answer:"))), "\n")


def canonical_id(passage_id: Column, several_fields: bool = True) -> Column:
    """The part before the first colon, where ids are made of several fields."""
    return F.split(passage_id, ":")[0] if several_fields else passage_id


def template_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def answer_tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def token_f1(prediction: Column, answer: Column) -> Column:
    """Harmonic mean of precision and recall of two texts' words, as multisets; 1 where both have none."""
    p, a = answer_tokens(prediction), answer_tokens(answer)
    shared = F.aggregate(
        F.array_distinct(p),
        F.lit(0),
        lambda n, w: n + F.least(F.size(F.filter(p, lambda x: x == w)), F.size(F.filter(a, lambda x: x == w))),
    )
    total = F.size(p) + F.size(a)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * shared / F.greatest(total, F.lit(1)))


def exact_match(prediction: Column, answer: Column) -> Column:
    return (F.array_join(answer_tokens(prediction), " ") == F.array_join(answer_tokens(answer), " ")).cast("int")


def json_value(document: Column, *path: str) -> Column:
    """The value at a path of field names as text; null where there is none or the document is no JSON."""
    return F.get_json_object(document, "$" + "".join(f"['{step}']" for step in path))


def json_merged(first: Column, second: Column) -> Column:
    """Two flat JSON objects as one with text values; fields of the second replace those of the first, null counts as empty."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string, string>"), F.create_map().cast("map<string, string>"))
    old, new = read(first), read(second)
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new))
