"""Text rules as Column builders: token sets, heuristics, gates on text, clean-up. All stay inside the JVM.

Null text counts as empty unless a function says otherwise. Words are Unicode words: `(?U)` in patterns is needed, as
Java's \\w is ASCII without it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

WORDS = r"(?U)\b[\w']+\b"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column, pattern: str = WORDS) -> Column:
    """Lower-cased words in order."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(pattern), F.lit(0))


def word_count(c: Column, pattern: str = WORDS) -> Column:
    return F.size(words(c, pattern))


def token_set(c: Column, pattern: str = WORDS, stop: Sequence[str] = ()) -> Column:
    found = F.array_distinct(words(c, pattern))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def binary_cosine(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    product = F.size(a) * F.size(b)
    return F.when(product == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(product))


def content_overlap(a: Column, b: Column, stop: Sequence[str] = C.OVERLAP_STOPWORDS) -> Column:
    """Jaccard of words of three and more of [a-z0-9'] without stop words; 0 if either set is empty."""
    x, y = (token_set(c, r"[a-z0-9']{3,}", stop) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(jaccard(x, y))


def hits(lowered: Column, terms: Sequence[str]) -> Column:
    """How many of the terms the text contains."""
    return sum((lowered.contains(t).cast("int") for t in terms), F.lit(0))


def length_class(n: Column) -> Column:
    return F.when(n < 8, "simple").when(n < 25, "normal").when(n < 50, "complex").otherwise("deep")


def complexity(c: Column, depth: Sequence[str] = C.DEPTH, comparison: Sequence[str] = C.COMPARISON) -> Column:
    """Struct (label, confidence) by length, then by depth markers, then by comparison."""
    t = text_of(c)
    low, n = F.lower(t), F.regexp_count(t, F.lit(r"\S+"))
    deep = hits(low, depth)
    sentences = F.size(F.filter(F.split(t, r"[.!?]+"), lambda s: F.trim(s) != ""))
    asked = F.regexp_count(t, F.lit(r"\?"))
    by_depth = F.when((deep >= 2) & (n >= 15), "deep").when((deep >= 1) & (n < 25) & (n >= 15), "complex").otherwise(length_class(n))
    parts = (by_depth == "normal") & ((hits(low, comparison) > 0) | (sentences >= 3) | (asked >= 2))
    sure = (
        F.when(parts, 0.60).when((deep >= 2) & (n >= 15), 0.70).when((deep >= 1) & (n < 25) & (n >= 15), 0.60)
        .when(n < 8, 0.75).when(n < 50, 0.65).otherwise(0.75)
    )
    return F.struct(F.when(parts, "complex").otherwise(by_depth).alias("label"), sure.alias("confidence"))


def sentiment(c: Column, lexicon: dict[str, Sequence[str]] = C.LEXICON) -> Column:
    """Struct (label, confidence): the label with most terms; a negation takes one from positive and motivated."""
    low = F.lower(text_of(c))
    negated = low.rlike(r"\b(not|never|no longer|isn't|aren't|don't)\s+\w{0,12}\b")
    raw = {k: hits(low, v) for k, v in lexicon.items()}
    score = {k: F.when(negated & F.lit(k in ("positive", "motivated")), F.greatest(F.lit(0), n - 1)).otherwise(n) for k, n in raw.items()}
    best = F.greatest(*score.values())
    total = F.greatest(F.lit(1), sum(score.values(), F.lit(0)))
    label = F.lit("neutral")
    for k in reversed(list(score)):  # the first label with the greatest count wins
        label = F.when((score[k] == best) & (best > 0), k).otherwise(label)
    return F.struct(label.alias("label"), F.when(best == 0, 0.30).otherwise(F.least(F.lit(0.65), 0.35 + 0.30 * best / total)).alias("confidence"))


def crisis(c: Column, phrases: Sequence[str] = C.CRISIS) -> Column:
    return text_of(c).rlike("(?i)" + "|".join(rf"\b{p}\b" for p in phrases))


def annotate(message: Column, reply: Column, resources: str, known: Sequence[str]) -> Column:
    """The reply, with the resources after it if the message needs them and the reply hasn't got them."""
    has = sum((reply.contains(k).cast("int") for k in known), F.lit(0)) > 0
    return F.when(crisis(message) & ~has, F.concat(F.rtrim(reply), F.lit(f"\n\n---\n{resources}"))).otherwise(reply)


def worth_remembering(c: Column, least: int = C.MEMORY_FLOOR, pronouns: Sequence[str] = ("i", "my", "me", "we", "our"), ascii_words: bool = False) -> Column:
    """Long enough, no mere heap of questions, and about the writer. ascii_words: only ASCII letters, digits and `_` are
    parts of words, as in RE2, so `la` is a word in `èla`; else letters of any script are, as in the reference."""
    t = F.trim(text_of(c))
    asks = (F.regexp_count(t, F.lit(r"\?")) >= 3) & (F.regexp_count(t, F.lit(r"\S+")) < 40)
    before, after = ("(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])") if ascii_words else (r"\b", r"\b")
    return (F.length(t) >= least) & ~asks & F.lower(t).rlike(f"{before}({'|'.join(pronouns)}){after}")


def memory_title(c: Column, width: int = 80) -> Column:
    line = F.substring_index(F.trim(text_of(c)), "\n", 1)
    return F.concat(F.substring(line, 1, width), F.when(F.length(line) > width, "...").otherwise(""))


def importance_of(label: Column) -> Column:
    return F.when(label == "simple", 3).when(label == "normal", 4).when(label == "complex", 6).when(label == "deep", 8).otherwise(5)


def fold_quotes(c: Column) -> Column:
    """Typographic apostrophes become plain; an adverb between `you` and its verb goes."""
    return F.regexp_replace(F.translate(text_of(c), "’‘", "''"), C.ADVERBS, "you $1")


def sentences(c: Column) -> Column:
    """Sentences with their end marks and the quotes or spaces after them."""
    return F.filter(F.regexp_extract_all(text_of(c), F.lit(r"(?s)[^.!?]*[.!?]+[\s\"')\]]*|[^.!?]+$"), F.lit(0)), lambda s: s != "")


def sentence_offsets(c: Column) -> Column:
    """Sentences as structs of `at`, the characters before one, and `sentence`. Together they are the whole text."""
    found = sentences(c)
    before = F.transform(found, lambda s, i: F.aggregate(F.slice(found, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x)))
    return F.zip_with(found, before, lambda s, at: F.struct(at.alias("at"), s.alias("sentence")))


def ends_with_question(c: Column) -> Column:
    return F.regexp_replace(F.trim(text_of(c)), r"[\"'”’)]+$", "").endswith("?")


def trailing_questions(c: Column) -> Column:
    """Length of the run of questions that the text ends with."""
    parts = F.filter(F.split(F.trim(text_of(c)), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("done"))
    step = lambda acc, s: F.struct((acc["n"] + F.when(~acc["done"] & F.trim(s).endswith("?"), 1).otherwise(0)).alias("n"), (acc["done"] | ~F.trim(s).endswith("?")).alias("done"))
    return F.aggregate(F.reverse(parts), start, step)["n"]


def first_marker(c: Column, markers: Sequence[str], question_counts: bool = False) -> Column:
    """The first marker that the text has: phrases anywhere, single words at the start of a word; else null."""
    import re

    low = F.lower(text_of(c))
    found = [F.when(low.contains(m.lower()) if " " in m or "-" in m else low.rlike(rf"(?U)\b{re.escape(m.lower())}\w*\b"), m) for m in markers]
    if question_counts:
        found.append(F.when(ends_with_question(c), "question-at-end"))
    return F.coalesce(*found, F.lit(None).cast("string"))


def advice(c: Column, phrases: Sequence[str] = (), constructions: bool = False) -> Column:
    """The first forbidden phrase outside questions and counterfactuals, else the advice construction, else null."""
    t = fold_quotes(c)
    directive = F.filter(sentences(t), lambda s: ~((s.rlike(C.WH_CLAUSE) & F.trim(s).endswith("?")) | s.rlike(C.COUNTERFACTUAL)))

    def holds(p: str) -> Column:
        return F.exists(directive, lambda s: F.lower(s).contains(p.lower()))

    out = [F.when(holds(p), p) for p in phrases]
    if constructions:
        out.append(F.nullif(F.trim(F.regexp_extract(t, C.ADVICE, 0)), F.lit("")))
    return F.coalesce(*out, F.lit(None).cast("string"))


def persona_checks(c: Column, frameworks: str = C.FRAMEWORKS, hedges: str = C.HEDGES, band: tuple[int, int] = C.WORD_BAND, end: str = "?") -> Column:
    """Struct of four 0/1 checks, their sum and the words."""
    t = F.trim(text_of(c))
    n = F.regexp_count(t, F.lit(r"\S+"))
    checks = {"ends_with_question": t.endswith(end), "uses_framework": t.rlike(frameworks), "no_hedging": ~t.rlike(hedges), "word_count_in_band": n.between(*band)}
    cols = [v.cast("int").alias(k) for k, v in checks.items()]
    return F.struct(*cols, sum((v.cast("int") for v in checks.values()), F.lit(0)).alias("persona_score"), n.alias("words"))


def chatml_turn(c: Column, role: str) -> Column:
    """The text of the first user turn, or of the first assistant turn after it."""
    pattern = r"(?s)<\|im_start\|>user\s*(.*?)<\|im_end\|>.*?<\|im_start\|>assistant\s*(.*?)<\|im_end\|>"
    return F.regexp_extract(text_of(c), pattern, 1 if role == "user" else 2)


def chatml(system: Column, user: Column, assistant: Column) -> Column:
    head, rest = C.CHATML.split("{system}")
    middle, rest = rest.split("{user}")
    gap, tail = rest.split("{assistant}")
    return F.concat(F.lit(head), system, F.lit(middle), user, F.lit(gap), assistant, F.lit(tail))


def plain_speech(c: Column) -> Column:
    """Without markdown: fences, code marks, bold, symbols, then links; spaces are joined last."""
    t = text_of(c)
    for pattern, to in ((r"(?s)```.*?```", " "), (r"`([^`]*)`", "$1"), (r"\*\*([^*]*)\*\*", "$1"), (r"[*_#>]", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def pauses(c: Column) -> Column:
    """A sentence's end before a capital or an Indic letter becomes an audible pause."""
    return F.regexp_replace(text_of(c), r"(?<=[.!?।])\s+(?=[A-Zऀ-෿])", "... ")


def clean_reply(c: Column) -> Column:
    """Without template tokens, and cut at a leaked turn that starts after the 40th character."""
    t = F.trim(text_of(c))
    for token in C.CHAT_TOKENS:
        t = F.replace(t, F.lit(token), F.lit(""))
    for mark in ("\nUser:", "\n\nUser:", "\nassistant\n"):
        t = F.when(F.instr(t, mark) > 41, F.substring(t, F.lit(1), F.instr(t, mark) - 1)).otherwise(t)
    return F.trim(t)


def lead_summary(c: Column, width: int = 300) -> Column:
    """The first two sentences, cut to a width."""
    return F.substring(F.array_join(F.slice(F.split(F.trim(text_of(c)), r"(?<=[.!?])\s+"), 1, 2), " "), 1, width)


def mark_terms(c: Column, query: str, least: int = 3) -> Column:
    """Words of the query that are long enough, marked in the text, any case."""
    import re

    terms = [re.escape(t) for t in query.split() if len(t) >= least]
    return F.regexp_replace(text_of(c), f"(?i)({'|'.join(terms)})", "<mark>$1</mark>") if terms else text_of(c)


def approx_tokens(c: Column) -> Column:
    return F.floor(F.length(text_of(c)) / 4)


def retry_after(header: Column, body: Column) -> Column:
    """Struct (seconds, daily) of a throttling reply: the header's seconds, else `try again in 1m2.5s`."""
    low = F.lower(text_of(body))
    short = low.rlike(r"per[\s_-]?(minute|min\b|second|sec\b|hour|hr\b)|\btpm\b|\brpm\b")
    day = low.rlike(r"per[\s_-]?day|\btpd\b|daily|per[\s_-]?24\s?h")
    broke = low.rlike(r"insufficient|payment[\s_-]?(method|required)|balance|out of credit")
    wait = r"try again in\s+(?:(\d+)m)?\s*([\d.]+)?s"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(low, wait, i), F.lit("")).try_cast("double"), F.lit(0.0))
    seconds = F.coalesce(F.trim(header).try_cast("double"), F.when(low.rlike(wait), part(1) * 60 + part(2)))
    return F.struct(seconds.alias("seconds"), (broke | (day & ~short)).alias("daily"))


def run_outcome(log: Column, have: Column, want: Column, code: Column, quota_marks: Sequence[str]) -> Column:
    return F.when(have >= want, "complete").when(hits(text_of(log), quota_marks) > 0, "quota").when(~code.isin(0, 2), "error").otherwise("short")


def goal_comment(pct: Column, days: Column) -> Column:
    """Class of a goal's state by progress and days left, first that holds."""
    late, rush = F.coalesce(days < 0, F.lit(False)), F.coalesce((days <= 3) & (pct < 60), F.lit(False))
    return F.when(pct >= 100, "done").when(late, "past due").when(rush, "scramble").when(pct == 0, "not started").when(pct < 30, "early").when(pct < 70, "halfway").otherwise("close")


def progress(current: Column, target: Column) -> Column:
    """Percent of a target, 100 at most; 0 if the target is 0 or null."""
    pct = F.try_divide(current, target) * 100
    return F.when(pct.isNull(), 0.0).otherwise(F.least(F.lit(100.0), pct))


def ago(seconds: Column) -> Column:
    """Relative age in the largest unit that fits, floored; null is unknown."""
    s = F.greatest(F.lit(0.0), seconds)
    unit = lambda by, name: F.concat(F.floor(s / by).cast("string"), F.lit(f"{name} ago"))
    m, h, d, mo = 60, 3600, 86400, 86400 * 30
    return F.when(seconds.isNull(), "unknown time").when(s < m, unit(1, "s")).when(s < h, unit(m, "m")).when(s < d, unit(h, "h")).when(s < mo, unit(d, "d")).when(s < mo * 12, unit(mo, "mo")).otherwise(unit(mo * 12, "y"))


def days_until(value: Column, now_us: int) -> Column:
    """Days from now to a date string, rounded up; null if it isn't a date."""
    return F.ceil((F.unix_micros(F.try_to_timestamp(value)) - F.lit(now_us)) / 8.64e10)


def short_date(value: Column, year: int) -> Column:
    """`5 Jan`, with the year unless it is the given one; what isn't a date keeps its first 10 characters."""
    t = F.try_to_timestamp(value)
    return F.when(t.isNull(), F.substring(value, 1, 10)).when(F.year(t) == year, F.date_format(t, "d MMM")).otherwise(F.date_format(t, "d MMM yyyy"))


def long_date(value: Column) -> Column:
    """`Thursday, August 14`; what isn't a date keeps its first 10 characters, nothing is ''."""
    t = F.try_to_timestamp(value)
    return F.when(text_of(value) == "", "").when(t.isNull(), F.substring(value, 1, 10)).otherwise(F.date_format(t, "EEEE, MMMM d"))


def parse_day(value: Column) -> Column:
    """Date of an ISO date or date and time; null is what a request would be refused for."""
    iso = value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?$")
    return F.when(iso, F.call_function("try_to_date", F.substring(value, 1, 10)))


def week_start(value: Column, today: Column) -> Column:
    """The given day, or the Monday of today's week if none is given."""
    return F.when(text_of(value) == "", F.date_trunc("week", today).cast("date")).otherwise(parse_day(value))


def bump(current: Column, target: Column, delta: Column) -> Column:
    """Progress after a step, from 0 to the target (1 if there is none)."""
    return F.greatest(F.lit(0.0), F.least(current + delta, F.coalesce(target, F.lit(1.0))))


def shown_percent(current: Column, target: Column) -> Column:
    """Whole percent, halves up, 100 at most; 0 without a target."""
    pct = F.try_divide(current, target) * 100
    return F.when(pct.isNull(), 0).otherwise(F.least(F.lit(100), F.floor(pct + 0.5).cast("int")))
