"""Text expressions: normal forms, token sets, set similarity, headings, names and conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave.functions import fixed


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Trim every kind of white space, not blanks alone."""
    return F.regexp_replace(col(value), r"^\s+|\s+$", "")


def blank(value: Column | str) -> Column:
    return F.coalesce(strip(value), F.lit("")) == ""


def or_blank(value: Column | str) -> Column:
    return F.coalesce(col(value), F.lit(""))


def null_if_blank(value: Column | str) -> Column:
    return F.when(~blank(value), col(value))


def squeeze(value: Column | str) -> Column:
    """Trim and collapse runs of white space."""
    return F.regexp_replace(strip(value), r"\s+", " ")


def normalize(value: Column | str) -> Column:
    return F.lower(squeeze(or_blank(value)))


def compact(value: Column | str) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(or_blank(value), r"\s+", ""))


def tokens(value: Column | str) -> Column:
    """Distinct words of two or more characters, plus the compact form of three or more."""
    norm, tight = normalize(value), compact(value)
    words = F.filter(F.split(norm, r"[^0-9a-zA-Z가-힣]+"), lambda t: F.length(t) >= 2)
    return F.array_distinct(
        F.when(F.length(tight) >= 3, F.array_append(words, tight)).otherwise(words)
    )


def char_ngrams(value: Column | str, n: int = 3) -> Column:
    """Distinct character n-grams of the compact form; a shorter text is one gram."""
    tight = compact(value)
    # A look-ahead with a group finds overlapping grams in one pass over the text.
    grams = F.array_distinct(F.regexp_extract_all(tight, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    return F.when(tight == "", F.array().cast("array<string>")).when(F.length(tight) < n, F.array(tight)).otherwise(grams)


def business_keys(value: Column | str) -> Column:
    upper = F.upper(or_blank(value))
    found = [F.regexp_extract_all(upper, F.lit(p), F.lit(0)) for p in fixed.BUSINESS_KEY_PATTERNS]
    return F.array_distinct(F.flatten(F.array(*found)))


def jaccard(left: Column | str, right: Column | str) -> Column:
    """Shared over total; 1 when both sets are empty, 0 when one is."""
    a, b = F.size(col(left)), F.size(col(right))
    shared = F.size(F.array_intersect(col(left), col(right)))
    return jaccard_counts(a, b, shared)


def jaccard_counts(left: Column, right: Column, shared: Column) -> Column:
    """The same from set sizes, for joins that count shared members."""
    return (
        F.when((left == 0) & (right == 0), F.lit(1.0))
        .when((left == 0) | (right == 0), F.lit(0.0))
        .otherwise(shared.cast("double") / (left + right - shared).cast("double"))
    )


def char_set(name: Column | str) -> Column:
    """Distinct characters of a name; two names are alike by the Jaccard of these sets."""
    return F.array_distinct(F.filter(F.split(col(name), ""), lambda x: x != ""))


def core_words(name: Column | str) -> Column:
    """Parts of a name between conjunctions, blanks removed first, particles dropped."""
    parts = F.split(F.replace(F.replace(col(name), F.lit(" "), F.lit("")), F.lit(fixed.CORE_CONJUNCTION), F.lit(" ")), r"\s+")
    stop = F.array(*[F.lit(w) for w in fixed.CORE_STOP_WORDS])
    return F.array_except(F.filter(parts, lambda p: p != ""), stop)


def heading_level(line: Column | str) -> Column:
    """Level of the first heading pattern a trimmed line matches, else null."""
    chain = F.lit(None).cast("int")
    for level, pattern in reversed(fixed.HEADING_PATTERNS):
        chain = F.when(col(line).rlike(pattern), F.lit(level)).otherwise(chain)
    return chain


def opens_semantic_group(paragraph: Column | str) -> Column:
    first = F.substring_index(col(paragraph), "\n", 1)
    found = F.lit(False)
    for pattern in fixed.SEMANTIC_BREAKS:
        found = found | first.rlike(pattern)
    return found


def merge_unique_lines(base: Column | str, extra: Column | str) -> Column:
    """Trimmed non-empty lines of ``base``, then lines of ``extra`` not seen before."""
    lines = lambda c: F.filter(
        F.transform(F.split(or_blank(c), r"\r\n|\r|\n"), strip), lambda x: x != ""
    )
    base_lines, extra_lines = lines(base), lines(extra)
    merged = F.array_join(F.concat(base_lines, F.array_except(extra_lines, base_lines)), "\n")
    return F.when(F.size(extra_lines) == 0, or_blank(base)).otherwise(merged)


def paragraphs(value: Column | str, separator: str = r"\n\s*\n") -> Column:
    """Trimmed non-empty paragraphs."""
    return F.filter(F.transform(F.split(or_blank(value), separator), strip), lambda p: p != "")


def snake_id(value: Column | str) -> Column:
    lowered = F.lower(strip(or_blank(value)))
    return F.regexp_replace(F.regexp_replace(lowered, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def safe_name(value: Column | str, limit: int | None = None) -> Column:
    """Name usable as a file name: letters, digits, dot, underscore and dash stay."""
    safe = F.regexp_replace(or_blank(value), r"[^\p{L}\p{N}._-]", "_")
    return F.substring(safe, 1, limit) if limit else safe


def _trim_marks(value: Column) -> Column:
    return F.regexp_replace(value, r"^[ .,\-_]+|[ .,\-_]+$", "")


def gateway_subject(text: Column | str) -> Column:
    """What a branch asks about: the words before the question marker, else the text without noise words."""
    s = squeeze(or_blank(text))
    found = [
        F.nullif(_trim_marks(squeeze(F.regexp_extract(s, pattern, 1))), F.lit(""))
        for pattern in fixed.GATEWAY_SUBJECT_PATTERNS
    ]
    rest = s
    for word in fixed.GATEWAY_NOISE_WORDS:
        rest = F.replace(rest, F.lit(word), F.lit(" "))
    return F.coalesce(*found, _trim_marks(squeeze(rest)))


def is_placeholder_gateway(name: Column | str) -> Column:
    key = compact(name)
    words = "|".join(fixed.GATEWAY_PLACEHOLDERS)
    return (key == "") | key.rlike(rf"^({words})$") | (key.rlike(rf"^({words})") & key.rlike(r"\d"))


def with_gateway_name(df: DataFrame, out: str, name: Column, description: Column, number: Column) -> DataFrame:
    """Name from the described subject, else a real name, else the name's subject, else numbered.

    The parts are columns of their own, so that each is worked out once per row.
    """
    staged = (
        df.withColumn("__clean", squeeze(or_blank(name))).withColumn("__by_text", gateway_subject(description))
        .withColumn("__by_name", gateway_subject("__clean")).withColumn("__number", number.cast("string"))
    )
    suffix = F.lit(fixed.GATEWAY_NAME_SUFFIX)
    chosen = (
        F.when(F.col("__by_text") != "", F.concat("__by_text", suffix))
        .when((F.col("__clean") != "") & ~is_placeholder_gateway("__clean"), F.col("__clean"))
        .when(F.col("__by_name") != "", F.concat("__by_name", suffix))
        .otherwise(F.concat(F.lit(fixed.GATEWAY_DEFAULT_NAME), F.col("__number")))
    )
    # A one-element explode keeps later filters on the name from repeating the whole expression.
    kept = [c for c in df.columns if c != out]
    return staged.select(*kept, F.explode(F.array(chosen)).alias(out))


def with_branch_conditions(df: DataFrame, yes: str, no: str, name: Column, description: Column) -> DataFrame:
    """Condition texts of the yes and no side of a two-way branch."""
    staged = df.withColumn("__by_text", gateway_subject(description)).withColumn("__by_name", gateway_subject(name))
    subject = F.when(F.col("__by_text") != "", F.col("__by_text")).when(F.col("__by_name") != "", F.col("__by_name"))
    staged = staged.withColumn("__subject", subject)
    return (
        staged.withColumn(yes, F.coalesce(F.concat("__subject", F.lit(fixed.TRUE_SUFFIX)), F.lit(fixed.TRUE_DEFAULT)))
        .withColumn(no, F.coalesce(F.concat("__subject", F.lit(fixed.FALSE_SUFFIX)), F.lit(fixed.FALSE_DEFAULT)))
        .drop("__by_text", "__by_name", "__subject")
    )


def clean_condition(condition: Column | str) -> Column:
    """Trimmed condition, blank when it is a placeholder."""
    return F.when(compact(condition).isin(fixed.PLACEHOLDER_CONDITIONS), F.lit("")).otherwise(
        strip(or_blank(condition))
    )


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(words))


def reusable_skill(name: Column | str, summary: Column | str, purpose: Column | str) -> Column:
    """Expertise worth keeping as a skill rather than a task-local instruction."""
    low = [F.lower(strip(or_blank(c))) for c in (name, summary, purpose)]
    text = strip(F.concat_ws(" ", *low))
    local = contains_any(text, fixed.SKILL_LOCAL_MARKERS)
    reusable = contains_any(text, fixed.SKILL_REUSABLE_MARKERS)
    generic = contains_any(text, fixed.SKILL_GENERIC_MARKERS)
    return (F.length(low[0]) >= 3) & ~(local & ~reusable) & (reusable | generic)


def human_required(*parts: Column | str) -> Column:
    """Wording that needs a person; any hint of automation overrides it."""
    text = compact(F.concat_ws(" ", *[or_blank(p) for p in parts]))
    return ~contains_any(text, fixed.AUTOMATION_WORDS) & contains_any(text, fixed.HUMAN_WORDS)


def procedure_steps(text: Column | str, sentences_at_most: int | None = None, characters: int | None = None) -> Column:
    """Numbered items, else bullets, else sentences; a default step for no text. Both bounds are off unless given: how many
    sentences are taken, and where a text without any is cut."""
    t = or_blank(text)
    keep = lambda a: F.filter(F.transform(a, strip), lambda s: s != "")
    numbered = F.regexp_extract_all(t, F.lit(fixed.NUMBERED_STEP), F.lit(1))
    bullets = F.regexp_extract_all(t, F.lit(fixed.BULLET_STEP), F.lit(1))
    sentences = F.transform(F.filter(F.split(t, fixed.SENTENCE_END), lambda s: (strip(s) != "") & (F.length(s) > 5)), strip)
    first = F.slice(sentences, 1, sentences_at_most) if sentences_at_most else sentences
    short = F.when(F.length(t) > characters, F.concat(F.substring(t, 1, characters), F.lit("..."))).otherwise(t) if characters else t
    return (
        F.when(t == "", F.array(F.lit(fixed.SKILL_DEFAULT_STEP)))
        .when(F.size(numbered) > 0, keep(numbered))
        .when(F.size(bullets) > 0, keep(bullets))
        .when(F.size(sentences) > 0, first)
        .otherwise(F.array(short))
    )


def skill_key(name: Column | str) -> Column:
    """Key safe in paths, at most 160 characters."""
    s = squeeze(or_blank(name))
    s = F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("_")), F.lit("/"), F.lit("_")), F.lit(".."), F.lit("_"))
    return F.substring(s, 1, 160)


def skill_name_from_markdown(markdown: Column | str) -> Column:
    """Name from the front matter, else the skill heading, else a first line that is a heading."""
    t = or_blank(markdown)
    front = F.regexp_extract(t, r"(?m)^---\s*\n[\s\S]*?^name:\s*(.+?)\s*$[\s\S]*?^---\s*$", 1)
    front = squeeze(F.regexp_replace(strip(front), r"^[\"']+|[\"']+$", ""))
    header = squeeze(F.regexp_extract(t, r"(?m)^#\s*Skill:\s*(.+)\s*$", 1))
    first = strip(F.substring_index(t, "\n", 1))
    title = F.when(first.startswith("#"), squeeze(F.regexp_replace(first, r"^#+", ""))).otherwise(F.lit(""))
    return F.when(front != "", front).when(header != "", header).otherwise(title)


def form_id(process_id: Column | str, activity_id: Column | str, tool: Column | str) -> Column:
    """Form named by the tool, else by process and activity; slashes become ``#``."""
    pid, aid, t = or_blank(process_id), strip(or_blank(activity_id)), strip(or_blank(tool))
    named = F.when(t.startswith("formHandler:"), strip(F.substring(t, 13, 1_000_000)))
    chosen = F.coalesce(null_if_blank(named), F.concat(pid, F.lit("_"), aid, F.lit("_form")))
    chosen = F.replace(chosen, F.lit("/"), F.lit("#"))
    fallback = F.concat(pid, F.lit("_"), F.lower(aid), F.lit("_form"))
    return F.when(chosen == "defaultform", fallback).otherwise(chosen)


def entity_id(scope: Column | str, kind: str, *parts: Column | str) -> Column:
    """Deterministic id: equal inputs give equal ids on every run."""
    return F.substring(F.sha2(F.concat_ws(":", col(scope), F.lit(kind), *[normalize(p) for p in parts]), 256), 1, 32)
