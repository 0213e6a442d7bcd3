"""Column functions on strings, JSON and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fidelis.functions.scalars import col

# Patterns of lines of code, and of named answers.
CODE_START, CODE_END = r"^\s*(def|import|from|class|for|while|if)\b", r"[{};]\s*$"
ANSWER_TAG, TAGGED, LEADING = "<final_answer>", r"^\s*\(?([a-d])\)?", r"^\s*\(([a-d])\)(?:\s|$)"
ANSWER_SAYS, ANSWER_PARENS = r"(?:final\s+answer|answer)\s*(?:is|:)\s*\(?([a-d])\)?", r"\(([a-d])\)"


def norm_text(c: str | Column) -> Column:
    """Lower case, zero-width spaces and runs of Unicode white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(col(c)), "​", " "), r"(?U)\s+", " "))


def token_set(c: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{N}_]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; both empty: 1."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b))))


def safe_id(prefix: str, c: str | Column, n: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit("e36:"), col(c).cast("string")), 256), 1, n))


def day_of(ts: str | Column) -> Column:
    return F.substring(col(ts), 1, 10)


def ts_key(ts: str | Column) -> Column:
    """A sort key of a time stamp: in ISO form one in UTC to the microsecond, anything else as it is (digits sort before letters in both)."""
    iso = F.try_to_timestamp(F.when(col(ts).rlike(r"^\d{4}-\d\d-\d\d"), col(ts)))
    return F.coalesce(F.date_format(F.to_utc_timestamp(iso, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), col(ts))


def context_prefix(turns: str | Column, end: str | Column) -> Column:
    """The first `end` turns of a shared context; all if there are fewer, none for 0."""
    return F.slice(col(turns), F.lit(1), F.greatest(col(end).cast("int"), F.lit(0)))


def conversation_so_far(turns: str | Column, n: int = 2, user_chars: int = 600, assistant_chars: int = 1200) -> Column:
    """The last n turns (struct with role and content) as a prompt shows them: the role in brackets, then the end of the text between fences."""
    last = F.slice(col(turns), F.greatest(F.size(col(turns)) - n + 1, F.lit(1)), F.lit(n))

    def shown(t: Column) -> Column:
        text = F.coalesce(t["content"], F.lit(""))
        role = F.coalesce(t["role"], F.lit("user"))
        return F.concat(F.lit("["), role, F.lit(']\n"""\n'), F.when(role == "assistant", tail_text(text, assistant_chars)).otherwise(tail_text(text, user_chars)), F.lit('\n"""'))

    return F.array_join(F.transform(last, shown), "\n")


def is_code(c: str | Column) -> Column:
    """A fence, or at least two lines that begin or end like code."""
    lines = F.split(col(c), r"\R")
    return (F.instr(col(c), "```") > 0) | (F.size(F.filter(lines, lambda x: x.rlike(CODE_START) | x.rlike(CODE_END))) >= 2)


def has_question(c: str | Column) -> Column:
    return F.instr(col(c), "?") > 0


def page_type(url: str | Column) -> Column:
    u = F.coalesce(col(url), F.lit("None"))
    has = lambda *parts: F.greatest(*[F.contains(u, F.lit(p)) for p in (*parts, parts[0])])
    return (
        F.when(has("/s?", "field-keywords", "/s/"), "search results")
        .when(has("/dp/", "/gp/product"), "product page")
        .when(has("cart"), "cart")
        .when(F.regexp_replace(u, "/+$", "").endswith(".com") | has("/ref=nav"), "home")
        .otherwise("other page")
    )


def action_label(action: str | Column, click: str | Column) -> Column:
    return F.when(col(action) == "click", F.translate(col(click), "_", " ")).otherwise(col(action))


def json_object(c: str | Column) -> Column:
    """JSON text of an object that may be encoded twice; null for anything else."""
    once = F.trim(col(c))
    twice = F.from_json(F.concat(F.lit('{"x":'), once, F.lit("}")), "x string")["x"]
    return F.when(once.startswith("{"), once).when(twice.startswith("{"), twice)


def cart_size(meta: str | Column) -> Column:
    return F.coalesce(F.json_array_length(F.get_json_object(json_object(meta), "$.cart_items")), F.lit(0))


def search_term(meta: str | Column) -> Column:
    return F.get_json_object(json_object(meta), "$.search_term[0].term")


def parse_answer(c: str | Column) -> Column:
    """"(x)" if exactly one choice is named. With an answer tag: right after the last one, else in parentheses at the start of the text;
    without: after "answer is" or "answer:", else anywhere in parentheses."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    found = lambda where, pattern: F.nullif(F.regexp_extract(where, pattern, 1), F.lit(""))
    tagged = F.coalesce(found(F.substring_index(low, ANSWER_TAG, -1), TAGGED), found(F.substring_index(low, ANSWER_TAG, 1), LEADING))
    said = F.array_distinct(F.regexp_extract_all(low, F.lit(ANSWER_SAYS), 1))
    shown = F.array_distinct(F.regexp_extract_all(low, F.lit(ANSWER_PARENS), 1))
    hits = F.when(F.size(said) > 0, said).otherwise(shown)
    one = F.when(F.instr(low, ANSWER_TAG) > 0, tagged).when(F.size(hits) == 1, F.get(hits, F.lit(0)))
    return F.concat(F.lit("("), one, F.lit(")"))


def final_episode(c: str | Column, mark: str = "\nDate: ") -> Column:
    """struct(before, last): cut at the last mark."""
    parts = F.split(col(c), mark)
    n = F.size(parts)
    return F.struct(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), mark).alias("before"), F.when(n > 1, F.concat(F.lit(mark), F.element_at(parts, -1))).alias("last"))


def format_options(c: str | Column) -> Column:
    """"(L) text" lines of a JSON array of {letter, option}."""
    return F.array_join(F.transform(F.from_json(col(c), "array<struct<letter:string,option:string>>"), lambda o: F.concat(F.lit("("), o["letter"], F.lit(") "), o["option"])), "\n")


def generated_text(c: str | Column) -> Column:
    """What stands after the first opening and before the first closing response tag, without thoughts."""
    inner = F.when(F.instr(col(c), "<response>") > 0, F.substring(col(c), F.instr(col(c), "<response>") + 10, F.length(col(c)))).otherwise(col(c))
    inner = F.substring_index(inner, "</response>", 1)
    return F.trim(F.regexp_replace(inner, r"(?s)<think>.*?</think>", ""))


def slug(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", "")


def head_text(c: str | Column, n: int) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.left(col(c), F.lit(n)), F.lit("…"))).otherwise(col(c))


def tail_text(c: str | Column, n: int) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.lit("…"), F.right(col(c), F.lit(n)))).otherwise(col(c))


def row_key(*columns: str | Column) -> Column:
    return F.concat_ws("|", *[col(c).cast("string") for c in columns])


def hashed_uniform(key: Column) -> Column:
    """A number in [0, 1) from a string key, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(16**13)


def mix_card(target: Column, other: Column, alpha: float, key: Column, sep: str = "; ") -> Column:
    """Fields of target with probability alpha, else of other; a field's draw is keyed by its number. Cards with different numbers of fields give null."""
    a, b = F.split(target, sep), F.split(other, sep)
    at = F.transform(a, lambda x, i: F.when(hashed_uniform(F.concat_ws(":", key, i.cast("string"))) < alpha, x).otherwise(F.get(b, i)))
    return F.when(F.size(a) == F.size(b), F.array_join(at, sep))


def char_wb_ngrams(c: str | Column, low: int = 3, high: int = 5) -> Column:
    """All n-grams of words padded with a space on both sides, with repetitions."""
    words = F.filter(F.split(F.lower(col(c)), r"\s+"), lambda w: w != "")

    def of(padded: Column, n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substr(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, every).otherwise(F.array().cast("array<string>"))

    def grams(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        return F.flatten(F.array(*[of(padded, n) for n in range(low, high + 1)]))

    return F.flatten(F.transform(words, grams))
