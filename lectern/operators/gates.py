"""Gates and guards: which rows pass, and why the others don't. Issues are arrays of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.sentences import sentence_units
from lectern.functions.text import force_period, protected_count

ROLES = ["system", "user", "assistant"]
LABEL_KEYS = ["main_idea", "key_points"]


def issues(checks: dict[str, Column]) -> Column:
    """Codes of the checks that are true; null counts as false."""
    return F.filter(F.array(*[F.when(c, F.lit(code)) for code, c in checks.items()]), lambda x: x.isNotNull())


def first_reason(checks: dict[str, Column]) -> Column:
    """Code of the first check that is true, else null: a reject cascade."""
    out = None
    for code, c in checks.items():
        out = F.when(c, code) if out is None else out.when(c, code)
    return out


def messages_of(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, messages: array of (role, content) in the order of turns."""
    g = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "role", "text"))).alias("m"))
    return g.select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


def replace_first(messages: Column, content: Column) -> Column:
    """The messages with the first one's content replaced."""
    return F.transform(messages, lambda m, i: F.when(i == 0, F.struct(m["role"].alias("role"), content.alias("content"))).otherwise(m))


def same_but_first(a: Column, b: Column) -> Column:
    """Whether two message arrays agree from the second on, by digest."""
    digest = lambda m: F.sha2(F.to_json(F.slice(m, 2, 1_000_000)), 256)
    return digest(a) == digest(b)


def role_violations(messages: Column) -> Column:
    """Codes for an order of roles other than system, user, assistant; and for blank contents."""
    roles = F.transform(messages, lambda m: m["role"])
    return issues({
        "count": F.size(messages) != 3,
        "order": roles != F.array(*[F.lit(r) for r in ROLES]),
        "blank": F.exists(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == ""),
    })


def first_of_role(messages: Column, role: str) -> Column:
    """Content of the first message of a role, null if there is none."""
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


LABEL = "main_idea string, key_points array<string>"


def _is(value: Column, kind: str) -> Column:
    """Whether a variant holds a kind of value (STRING, ARRAY and so on); false for null."""
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _label(text: Column) -> tuple[Column, Column, Column, Column]:
    """Of a label's JSON: its keys (null if it is no object), idea and points as variants, points as an array."""
    v = F.try_parse_json(text)
    idea, points = F.variant_get(v, "$.main_idea", "variant"), F.variant_get(v, "$.key_points", "variant")
    return F.when(v.isNotNull(), F.json_object_keys(text)), idea, points, F.when(_is(points, "ARRAY"), F.try_variant_get(points, "$", "array<variant>"))


def label_issues(text: Column, points: int = 4, sentences: int = 2) -> Column:
    """Codes of what is wrong with a label's JSON.

    It must be an object with the two keys, a string of `sentences` sentences and an array of `points`
    strings of one sentence each: values of other types are issues, not cast.
    """
    keys, idea, listed, items = _label(text)
    object_ = F.coalesce(keys.isNotNull(), F.lit(False))
    expected = F.array(*[F.lit(k) for k in LABEL_KEYS])
    string = lambda x: F.try_variant_get(x, "$", "string")
    plain = F.filter(items, lambda x: _is(x, "STRING"))
    full = F.filter(F.transform(plain, string), lambda x: F.trim(x) != "")
    return issues({
        "not_object": ~object_,
        "missing_keys": object_ & (F.size(F.array_except(expected, keys)) > 0),
        "extra_keys": object_ & (F.size(F.array_except(keys, expected)) > 0),
        "main_idea_not_string": object_ & ~_is(idea, "STRING"),
        "key_points_not_array": object_ & ~_is(listed, "ARRAY"),
        "main_idea_sentences": _is(idea, "STRING") & (protected_count(string(idea)) != sentences),
        "key_points_count": F.size(items) != points,
        "key_point_not_string": F.size(plain) < F.size(items),
        "key_point_empty": F.size(full) < F.size(plain),
        "key_point_sentences": F.exists(full, lambda x: protected_count(x) != 1),
    })


def output_flags(text: Column, points: int = 4, sentences: int = 2, least: int = 35, most: int = 180) -> dict[str, Column]:
    """Flags of generated output: whether it is an object of the two keys in order, its types and sentence
    counts, blank strings, and a length in words outside least and most. Text that is no object has the
    flags of a label without values, and its own words count."""
    keys, idea, listed, items = _label(text)
    plain = F.filter(items, lambda x: _is(x, "STRING"))
    strings = F.transform(plain, lambda x: F.try_variant_get(x, "$", "string"))
    main = F.when(_is(idea, "STRING"), F.try_variant_get(idea, "$", "string"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    is_list, of_strings, n = _is(listed, "ARRAY"), yes(F.size(plain) == F.size(items)), F.size(items)
    order = yes(keys == F.array(*[F.lit(k) for k in LABEL_KEYS]))
    said = F.filter(F.concat(F.array(main), F.coalesce(strings, F.array().cast("array<string>"))), lambda x: x.isNotNull())
    words = F.regexp_count(F.when(F.size(said) > 0, F.array_join(said, " ")).otherwise(text), F.lit(r"\S+"))
    return {
        "json_object": keys.isNotNull(),
        "exact_key_order": order,
        "main_idea_string": main.isNotNull(),
        "key_points_list": is_list,
        "exactly_4_key_points": yes(is_list & (n == points)),
        "all_key_points_strings": is_list & of_strings,
        "schema_pass": order & main.isNotNull() & of_strings & yes(n == points),
        "main_idea_two_sentences": yes(protected_count(main) == sentences),
        "each_key_point_one_sentence": of_strings & yes(n == points) & yes(~F.exists(strings, lambda x: protected_count(x) != 1)),
        "has_empty_string": yes(F.trim(text) == "") | yes(F.trim(main) == "") | yes(F.exists(strings, lambda x: F.trim(x) == "")),
        "output_too_short": yes(words < least),
        "output_too_long": yes(words > most),
    }


def canonical_label(text: Column) -> Column:
    """JSON of a label without issues: each sentence and point collapsed, with one period at its end. Else null."""
    label = F.from_json(text, LABEL)
    idea = F.array_join(F.transform(sentence_units(label["main_idea"]), force_period), " ")
    made = F.to_json(F.struct(idea.alias("main_idea"), F.transform(label["key_points"], force_period).alias("key_points")))
    return F.when(F.size(label_issues(text)) == 0, made)


def guard(text: Column, points: int = 4) -> Column:
    """(action, label): pass, truncated beyond `points`, or error with a null label.

    An error is anything but exactly the two keys, a string and an array of strings, none blank, or
    fewer than `points` of them.
    """
    keys, idea, _, items = _label(text)
    strings = F.filter(F.transform(F.filter(items, lambda x: _is(x, "STRING")), lambda x: F.try_variant_get(x, "$", "string")), lambda p: F.trim(p) != "")
    n = F.coalesce(F.size(strings), F.lit(0))
    main = F.when(_is(idea, "STRING"), F.try_variant_get(idea, "$", "string"))
    ok = (F.array_sort(keys) == F.array(*[F.lit(k) for k in sorted(LABEL_KEYS)])) & (F.trim(main) != "") & (n == F.size(items))
    action = F.when(~F.coalesce(ok, F.lit(False)) | (n < points), "error").when(n > points, "truncated").otherwise("pass")
    cut = F.struct(main.alias("main_idea"), F.slice(strings, 1, points).alias("key_points"))
    return F.struct(action.alias("action"), F.when(action != "error", F.to_json(cut)).alias("label"))


def request_checks(items: DataFrame, request: str, item: str, text: str, most: int, size: int) -> DataFrame:
    """Each request's status: empty, too_many, duplicate_ids, too_large or ok."""
    g = items.groupBy(request).agg(F.count("*").alias("n"), F.countDistinct(item).alias("ids"), F.max(F.length(text)).alias("longest"), F.min(F.length(F.trim(text))).alias("shortest"))
    status = first_reason({"too_many": F.col("n") > most, "duplicate_ids": F.col("ids") < F.col("n"), "empty": F.col("shortest") == 0, "too_large": F.col("longest") > size})
    return g.select(request, "n", F.coalesce(status, F.lit("ok")).alias("status"))
