"""Text columns: tokens, markup, clauses, masks, keys, tags, cookies. All native expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic, left out of queries and documents alike.
STOP_EN = (
    "a an the is are am to in on of for and or how what do does did with my can i it this that be at by from as me we you your not no so if then than too very just about into over after why when which who "
    "will would could should there here out up down off again once have has had was were been being get got make use using want need help please tell show give let some any all each both few more most other such only own same also"
).split()
STOP_CJK = (
    "帮我 怎么 什么 一下 这个 那个 区别 可以 哪些 哪里 怎样 如何 是不是 有没有 请问 讲讲 用到 有关 相关 的话 我们 你们 他们 就是 还有 需要 想要 实现 进行 处理 一个 一些 为啥 为何 以及 或者 如果 因为 所以 但是 然后 现在 已经 还是 应该 知道 明白 看看 说说 出来 起来 不了 得先 会不会 能不能"
).split()
# The scripts that are cut into bigrams (Han with extension A and compatibility forms, kana, hangul).
CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"
ASCII_TOKEN = r"[a-z0-9][a-z0-9_.+-]*"


def _literals(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def lex_tokens(text: Column, stop: Sequence[str] = (*STOP_EN, *STOP_CJK), pattern: str = ASCII_TOKEN) -> Column:
    """Tokens of the lower-cased text without stop words: ASCII words first, then bigrams of each CJK run (a run of
    one character as it is). The default pattern splits at accented letters; pass another to widen it. Null: none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(f"({pattern})"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(f"([{CJK}]+)"), F.lit(1))
    bigrams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    tokens = F.concat(words, bigrams)
    return F.filter(tokens, lambda t: ~t.isin(*stop)) if stop else tokens


def strip_markup(text: Column) -> Column:
    """Without fenced blocks (also unterminated ones) and quoted lines, trimmed and in lower case."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    # most texts have neither; looking for the marks is far cheaper than the patterns
    bare = F.when(F.contains(low, F.lit("```")) | F.contains(low, F.lit("~~~")), F.regexp_replace(low, r"(?s)```.*?(?:```|\z)|~~~.*?(?:~~~|\z)", "")).otherwise(low)
    return F.when(F.contains(low, F.lit(">")), F.regexp_replace(bare, r"(?m)^\s*>.*$", "")).otherwise(bare)


# Where clauses end, and the words that negate one.
CLAUSES = "[，,。；;\n!?？！]|(?<![a-z0-9_])but(?![a-z0-9_])|但是|而是"
NEGATION = "不(?:要|用|使用|加载|启用|运行)|别(?:用|使用|加载|运行|拿)|勿(?:用|使用|加载)|禁止|排除|无需|(?<![a-z0-9_])(?:do not|don't|without|exclude|not using)(?![a-z0-9_])"


def clauses(text: Column, negated: bool) -> Column:
    """The clauses of a text that say what not to do, or the others."""
    return F.filter(F.split(text, CLAUSES), lambda c: c.rlike(NEGATION) if negated else ~c.rlike(NEGATION))


def split_clauses(text: Column, negates: Column) -> tuple[Column, Column]:
    """(the clauses that aren't negated, joined by spaces; the others, by line). negates: text.rlike(NEGATION), where it is a column
    already; a clause that negates makes its text do so, and without one the text is only to be cut."""
    active = F.when(negates, F.array_join(clauses(text, False), " ")).otherwise(F.regexp_replace(text, CLAUSES, " "))
    return active, F.when(negates, F.array_join(clauses(text, True), "\n")).otherwise("")


def active_text(text: Column) -> Column:
    """The clauses that aren't negated, joined by spaces."""
    return F.array_join(clauses(text, False), " ")


def mask_terms(text: Column, terms: Sequence[str]) -> Column:
    """Each term, in order, written over with as many '#'."""
    for t in terms:
        if t:
            text = F.replace(text, F.lit(t), F.lit("#" * len(t)))
    return text


# The words that tell what a request wants, the first kind that has one counting, and the wish to leave all as it is.
MODES = [
    ("review", ("审阅", "审计", "复查", "review", "audit")),
    ("plan", ("规划", "商讨", "先计划", "plan", "brainstorm")),
    ("explain", ("解释", "讲述", "盘点", "讲解", "讨论", "找找", "explain", "overview", "catalog")),
]
OTHER_MODE = "implement"
READ_ONLY = r"不(?:要)?(?:再|直接|擅自)?(?:修改|改动|实现|写入|执行)|(?:禁止|勿)(?:再|直接|擅自)?(?:修改|改动|实现|写入|执行)|(?<![a-z0-9_])(?:read[- ]only|do not (?:edit|modify|implement|execute)|don't (?:edit|modify|implement|execute))(?![a-z0-9_])"


def mode_runs(text: Column) -> Column:
    from .patterns import runs_of

    return runs_of(text, [w for _, words in MODES for w in words])


def mode_of(text: Column, runs: Column | None = None) -> Column:
    """review, plan, explain or implement; a read-only wish is a review. runs: mode_runs(text), where it is a column already."""
    from .patterns import holds_any

    runs = mode_runs(text) if runs is None else runs
    out = F.lit(OTHER_MODE)
    for mode, words in reversed(MODES):
        out = F.when(holds_any(text, runs, words), mode).otherwise(out)
    return F.when(text.rlike(READ_ONLY), MODES[0][0]).otherwise(out)


def norm_key(text: Column, kind: str = "collapse") -> Column:
    """Keys for comparing texts: collapse (lower case, single spaces), squeeze (no white space, first 200 characters), dash ('_' as '-')."""
    if kind == "collapse":
        return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    if kind == "squeeze":
        return F.left(F.regexp_replace(text, r"\s+", ""), F.lit(200))
    if kind == "dash":
        return F.translate(text, "_", "-")
    raise ValueError(f"no such key: {kind}")


def lang_tag(text: Column) -> Column:
    """zh where more than 0.3 of the characters are CJK, mixed where any is, else en."""
    n = F.length(F.regexp_replace(text, f"[^{CJK}]", ""))
    return F.when(n > 0.3 * F.greatest(F.length(text), F.lit(1)), "zh").when(n > 0, "mixed").otherwise("en")


# Code points of emoji (plain digits, # and * don't count).
EMOJI = "[\U0001f1e6-\U0001f1ff]{2}|[\U0001f300-\U0001faff☀-➿⭐⭕⌚⌛⏩-⏳⤴⤵〰〽]|[0-9#*]️?⃣"


def has_emoji(text: Column) -> Column:
    return text.rlike(EMOJI)


# Characters that show up where GBK bytes were read in another encoding.
MOJIBAKE = "鍗鈫閫閮鎹鏄涓鍙鍧鍩鍨鐭鏉鏀鑴鏍"


def has_mojibake(text: Column) -> Column:
    return text.rlike(f"[{MOJIBAKE}]")


def excerpt(text: Column, n: int) -> tuple[Column, Column]:
    """(first n characters, length of the whole)."""
    return F.left(text, F.lit(n)), F.length(text)


def doc_text(name: Column, description: Column, budget: int = 160) -> Column:
    """'name: description', the description cut to `budget` characters."""
    return F.concat_ws(": ", name, F.left(description, F.lit(budget)))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cookie_pairs(text: Column) -> Column:
    """[(name, value)] of a cookie header, in order; parts without '=' have an empty value."""
    parts = F.filter(F.transform(F.split(text, ";"), F.trim), lambda p: p != "")
    at = lambda p: F.instr(p, "=")
    return F.transform(parts, lambda p: F.struct(F.trim(F.when(at(p) > 0, F.substring(p, F.lit(1), at(p) - 1)).otherwise(p)).alias("name"), F.trim(F.when(at(p) > 0, p.substr(at(p) + 1, F.length(p))).otherwise(F.lit(""))).alias("value")))


def last_wins(pairs: Column, key: str, value: str) -> Column:
    """Map of an array of structs in which the last entry of a key counts."""
    reversed_ = F.reverse(pairs)
    keys = F.transform(reversed_, lambda p: p[key])
    first = F.filter(reversed_, lambda p, i: F.array_position(keys, p[key]) == i + 1)
    return F.map_from_entries(F.transform(F.reverse(first), lambda p: F.struct(p[key], p[value])))


def cookie_map(text: Column) -> Column:
    return last_wins(cookie_pairs(text), "name", "value")


def pick_field(payload: Column, names: Sequence[str]) -> Column:
    """The first field of a JSON object that holds a non-empty string."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(payload, f"$.{n}")), F.lit("")) for n in names))
