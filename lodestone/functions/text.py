"""Sentences and the request parser, as column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words for visual subjects that a request may name.
VISUAL_SUBJECTS = [
    "beach", "ocean", "lake", "river", "waterfall", "mountain", "mountains",
    "forest", "desert", "snow", "sunset", "sunrise", "sky", "landscape",
    "food", "meal", "coffee", "cake", "dessert", "drink",
    "dog", "dogs", "cat", "cats", "pet", "pets", "bird", "horse", "fish",
    "flower", "flowers", "tree", "trees", "garden", "plant", "plants",
    "car", "cars", "boat", "bike", "motorcycle", "plane", "train",
    "baby", "wedding", "birthday", "party", "concert", "graduation",
    "fireworks", "selfie", "selfies", "portrait", "art", "painting", "tattoo",
]
#: Verbs that make a text a scan request.
SCAN_VERBS = [
    "scan", "find", "search", "look", "show", "get", "clean", "cleanup",
    "review", "dedupe", "deduplicate", "remove", "delete", "check", "see",
    "compare", "organize", "sort", "identify", "detect", "gather", "do", "pull", "grab",
]
#: Nouns that make a text a scan request.
OBJECT_NOUNS = [
    "photo", "photos", "picture", "pictures", "pic", "pics", "image", "images",
    "shot", "shots", "duplicate", "duplicates", "dupe", "dupes",
    "screenshot", "screenshots",
]
#: Other words that name no subject.
FILLER = [
    "my", "the", "a", "an", "some", "any", "all", "me", "for", "of", "and",
    "from", "in", "at", "to", "on", "with", "that", "those", "these", "is",
    "be", "but", "up", "about", "please", "can", "could", "would", "you", "i",
    "we", "us", "give", "want", "need", "help", "similar", "trip", "trips",
    "everything", "anything", "stuff", "things", "thing", "only", "just",
    "also", "into", "over",
    "recent", "recently", "lately", "last", "past", "this", "day", "days",
    "week", "weeks", "weekend", "month", "months", "year", "years",
    "yesterday", "today",
    "conservative", "conservatively", "careful", "carefully", "safe", "safely",
    "aggressive", "aggressively", "thorough", "thoroughly", "loose", "loosely",
    "balanced", "drone", "burst", "mode",
    "without", "no", "skip", "exclude", "not", "including", "include",
]
#: Modes in the order they are looked for, with their words.
MODES = {"conservative": ["conservative", "careful", "safe"], "aggressive": ["aggressive", "thorough", "loose"], "balanced": ["balanced"], "droneBurst": ["drone", "burst"]}
#: Ways to leave screenshots out.
NO_SCREENSHOTS = ["no screenshot", "without screenshot", "skip screenshot", "exclude screenshot", "not screenshot", "no screenshots"]
#: Date phrases in the order they are looked for.
DATE_PHRASES = {
    "lastWeekend": ["last weekend", "this past weekend"],
    "lastWeek": ["last week", "past week"],
    "lastMonth": ["last month", "past month"],
    "lastYear": ["last year", "past year"],
    "yesterday": ["yesterday"],
    "today": ["today"],
}
#: Word that must be in a text for a proposed phrase to count.
PHRASE_WORD = {"today": "today", "yesterday": "yesterday", "lastWeekend": "weekend", "lastWeek": "week", "lastMonth": "month", "lastYear": "year"}
#: How phrases and modes are spoken.
SPOKEN_PHRASE = {"today": "today", "yesterday": "yesterday", "lastWeekend": "last weekend", "lastWeek": "last week", "lastMonth": "last month", "lastYear": "last year"}
SPOKEN_MODE = {"conservative": "conservative", "balanced": "balanced", "aggressive": "aggressive", "droneBurst": "drone burst"}
MODE_SENSITIVITY = {"conservative": "conservative", "balanced": "balanced", "aggressive": "aggressive", "droneBurst": "aggressive"}
RECENT, RECENT_AT_PLACE = 300, 1000


def _first(text: Column, table: dict[str, list[str]]) -> Column:
    """Key of the first entry with a word in the text, else null."""
    out = F.lit(None).cast("string")
    for name, words in reversed(table.items()):
        out = F.when(_contains_any(text, words), name).otherwise(out)
    return out


def _contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _look_up(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def mode(lower: Column) -> Column:
    return _first(lower, MODES)


def date_phrase(lower: Column) -> Column:
    return _first(lower, DATE_PHRASES)


def excludes_screenshots(lower: Column) -> Column:
    return _contains_any(lower, NO_SCREENSHOTS)


def subject(lower: Column) -> tuple[Column, Column]:
    """(content, place) of a framed request: words that all name visual subjects, or else a place."""
    words = F.filter(F.split(lower, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    framed = F.exists(words, lambda w: w.isin(SCAN_VERBS + OBJECT_NOUNS))
    own = F.filter(words, lambda w: (F.length(w) >= 2) & w.rlike(r"\p{L}") & ~w.isin(SCAN_VERBS + OBJECT_NOUNS + FILLER))
    named = framed & (F.size(own) > 0)
    visual = F.forall(own, lambda w: w.isin(VISUAL_SUBJECTS))
    text = F.array_join(own, " ")
    return F.when(named & visual, text), F.when(named & ~visual, text)


def date_range(phrase: Column, now: Column) -> tuple[Column, Column]:
    """Half-open range of a phrase; weeks begin on Monday."""
    day, week, month, year = (F.date_trunc(x, now) for x in ("day", "week", "month", "year"))
    back = lambda ts, **k: ts - F.make_dt_interval(days=F.lit(k["days"]))
    start = (
        F.when(phrase == "today", day)
        .when(phrase == "yesterday", back(day, days=1))
        .when(phrase == "lastWeekend", back(week, days=2))
        .when(phrase == "lastWeek", back(week, days=7))
        .when(phrase == "lastMonth", F.add_months(month, -1).cast("timestamp"))
        .when(phrase == "lastYear", F.add_months(year, -12).cast("timestamp"))
    )
    end = F.when(phrase == "today", now).when(phrase == "yesterday", day).when(phrase.isin("lastWeekend", "lastWeek"), week).when(phrase == "lastMonth", month).when(phrase == "lastYear", year)
    return start, end


def settings_summary(mode: Column, phrase: Column, limit: Column, content: Column, place: Column, screenshots: Column) -> Column:
    noun = F.coalesce(F.concat(content, F.lit(" photos")), F.lit("photos"))
    scope = F.when(phrase.isNotNull(), F.concat(noun, F.lit(" from "), _look_up(phrase, SPOKEN_PHRASE))).otherwise(F.concat(F.lit("your "), limit.cast("string"), F.lit(" most recent "), noun))
    at = F.coalesce(F.concat(F.lit(" at "), place), F.lit(""))
    shots = F.when(screenshots, "including screenshots").otherwise("excluding screenshots")
    return F.concat(F.initcap(_look_up(mode, SPOKEN_MODE)), F.lit(" scan of "), scope, at, F.lit(", "), shots, F.lit("."))


def parse_requests(requests: DataFrame, now: datetime, default_mode: str = "balanced") -> DataFrame:
    """text → mode, phrase, start_ts, end_ts, recent_limit, include_screenshots, content and place
    queries, sensitivity, require_review (always true), understood, summary.

    Blank text is never parsed: its row has nulls and isn't understood.
    """
    out = requests.withColumn("lower", F.lower(F.trim("text")))
    lower = F.col("lower")
    content, place = subject(lower)
    out = out.withColumns({"named_mode": mode(lower), "phrase": date_phrase(lower), "content_query": content, "location_query": place, "include_screenshots": ~excludes_screenshots(lower)})
    out = out.withColumn("mode", F.coalesce("named_mode", F.lit(default_mode)))
    start, end = date_range(F.col("phrase"), F.lit(now).cast("timestamp"))
    limit = F.when(F.col("phrase").isNull(), F.when(F.col("location_query").isNotNull(), RECENT_AT_PLACE).otherwise(RECENT))
    out = out.withColumns({"start_ts": start, "end_ts": end, "recent_limit": limit, "sensitivity": _look_up(F.col("mode"), MODE_SENSITIVITY), "require_review": F.lit(True)})
    signals = ["phrase", "named_mode", "content_query", "location_query"]
    understood = F.coalesce(~F.col("include_screenshots"), F.lit(False))
    for c in signals:
        understood = understood | F.col(c).isNotNull()
    summary = settings_summary(F.col("mode"), F.col("phrase"), F.col("recent_limit"), F.col("content_query"), F.col("location_query"), F.col("include_screenshots"))
    out = out.withColumns({"understood": understood, "summary": summary})
    said = F.coalesce(F.length("lower") > 0, F.lit(False))
    columns = ["mode", "phrase", "start_ts", "end_ts", "recent_limit", "include_screenshots", "content_query", "location_query", "sensitivity", "require_review", "summary"]
    return out.select(*requests.columns, *[F.when(said, F.col(c)).alias(c) for c in columns], (said & F.col("understood")).alias("understood"))


def cleaned(text: Column) -> Column:
    """Trimmed lower case; blank and "none" are null."""
    low = F.lower(F.trim(text))
    return F.when((low != "") & (low != "none"), low)


def resolve_drafts(drafts: DataFrame, now: datetime, default_mode: str = "balanced") -> DataFrame:
    """Structured proposals (text, draft_mode, draft_phrase, draft_content, draft_location,
    draft_screenshots) made safe: dates and contents count only if the text names them.
    """
    text = F.lower("text")
    phrase = F.lit(None).cast("string")
    for k, w in PHRASE_WORD.items():
        phrase = F.when((F.col("draft_phrase") == k) & text.contains(w), k).otherwise(phrase)
    content = cleaned(F.col("draft_content"))
    out = drafts.withColumns(
        {
            "mode": F.coalesce(F.when(F.col("draft_mode").isin(list(MODES)), F.col("draft_mode")), mode(F.lower("draft_mode")), F.lit(default_mode)),
            "phrase": phrase,
            "content_query": F.when(text.contains(content), content),
            "location_query": cleaned(F.col("draft_location")),
        }
    )
    start, end = date_range(F.col("phrase"), F.lit(now).cast("timestamp"))
    limit = F.when(F.col("phrase").isNull(), F.when(F.col("location_query").isNotNull(), RECENT_AT_PLACE).otherwise(RECENT))
    out = out.withColumns({"start_ts": start, "end_ts": end, "recent_limit": limit})
    summary = settings_summary(F.col("mode"), F.col("phrase"), F.col("recent_limit"), F.col("content_query"), F.col("location_query"), F.col("draft_screenshots"))
    return out.withColumn("summary", summary)


def joined(parts: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(parts)
    return F.when(n <= 2, F.array_join(parts, " and ")).otherwise(F.concat(F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(parts, -1)))


def plural(word: str, n: Column) -> Column:
    return F.when(n == 1, word).otherwise(word + "s")


def counted(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), plural(word, n))


#: What a keeper's badges say of it, in order.
PREDICATES = {"Sharpest": "is the sharpest image", "Best exposure": "has the best exposure", "Highest resolution": "has the highest resolution", "Has people": "includes people", "Favorite": "is a favorite", "Edited": "is your edited version"}
#: Why a member is protected.
EXPLANATIONS = {"favorite": "it is a favorite", "edited": "it has edits", "livePhoto": "it is a Live Photo", "hidden": "it is hidden", "shared": "it is in a shared album", "hasPeople": "it contains people"}


def keeper_summary(badges: Column) -> Column:
    parts = F.array_compact(F.array(*[F.when(F.array_contains(badges, b), p) for b, p in PREDICATES.items()]))
    return F.when(F.size(parts) == 0, "Recommended as the best of this group.").otherwise(F.concat(F.lit("Recommended because it "), joined(parts), F.lit(".")))


def protection_summary(reasons: Column) -> Column:
    parts = F.transform(reasons, lambda r: _look_up(r, EXPLANATIONS))
    return F.when(F.size(reasons) > 0, F.concat(F.lit("Protected because "), joined(parts), F.lit(".")))


def removal_summary(badges: Column) -> Column:
    more = F.when(F.array_contains(badges, "Blurry"), " and has more motion blur").when(F.array_contains(badges, "Lower resolution"), " and is lower resolution").otherwise("")
    return F.concat(F.lit("Suggested removal because it is visually similar"), more, F.lit("."))


def cleanup_summary(groups: Column, reviewable: Column, favorites: Column, live: Column, people: Column) -> Column:
    parts = F.array_compact(F.array(F.when(favorites > 0, counted(favorites, "favorite")), F.when(live > 0, F.concat(live.cast("string"), F.lit(" Live "), plural("Photo", live))), F.when(people > 0, F.concat(counted(people, "photo"), F.lit(" with people")))))
    protected = F.when(F.size(parts) > 0, F.concat(F.lit(" I protected "), joined(parts), F.lit("."))).otherwise("")
    return F.when(groups == 0, "No duplicate groups yet. Try running a scan first.").otherwise(F.concat(F.lit("I found "), groups.cast("string"), F.lit(" similar-photo "), plural("group", groups), F.lit(". I recommend reviewing "), counted(reviewable, "photo"), F.lit(" for cleanup."), protected))


def session_summary(clusters: Column, best: Column, protected: Column, redundant: Column) -> Column:
    said = F.concat(
        F.lit("Found "), clusters.cast("string"), F.lit(" sequence "), plural("group", clusters),
        F.lit(". Recommended "), best.cast("string"), F.lit(" best "), plural("shot", best),
        F.lit(". Protected "), protected.cast("string"), F.lit(" unique "), plural("angle", protected),
        F.lit(". Suggested removing "), redundant.cast("string"), F.lit(" redundant "), plural("photo", redundant), F.lit("."),
    )
    return F.when(clusters == 0, "No photo sessions found yet. Try a drone or burst scan first.").otherwise(said)


def last_scan_summary(groups: Column, removable: Column) -> Column:
    said = F.concat(F.lit("Your last scan found "), counted(groups, "group"), F.lit(" with about "), counted(removable, "photo"), F.lit(" you can review."))
    return F.when(groups == 0, "No duplicate groups yet. Try running a scan first.").otherwise(said)


def group_details(confidence: Column, members: Column, badges: Column, removals: Column, protected: Column) -> Column:
    return F.concat(
        F.lit("This is a "), F.floor(confidence * 100 + 0.5).cast("string"), F.lit("% match of "), members.cast("string"), F.lit(" photos. "), keeper_summary(badges),
        F.lit(" "), counted(removals, "photo"), F.lit(" suggested for removal, "), protected.cast("string"), F.lit(" protected and kept."),
    )


# texts for a language model: facts that were worked out before, and nothing else


def _facts(badges: Column) -> Column:
    return F.coalesce(F.nullif(F.replace(badges, F.lit(","), F.lit(", ")), F.lit("")), F.lit("none"))


def keeper_prompt(confidence: Column, keeper_badges: Column, removal_badges: Column) -> Column:
    """Asks why a photo is kept; badges are comma-joined, null or empty where there are none."""
    return F.concat(
        F.lit("A group of similar photos matches at "), F.floor(confidence * 100 + 0.5).cast("int").cast("string"),
        F.lit(" percent. Facts about the photo to keep: "), _facts(keeper_badges), F.lit(". Facts about the others: "), _facts(removal_badges),
        F.lit(". Say in one friendly sentence why that photo is kept. Use these facts only."),
    )


def cleanup_prompt(groups: Column, reviewable: Column, favorites: Column, live: Column, people: Column) -> Column:
    """Asks for a summary of a scan's tallies."""
    return F.format_string("A scan found %d groups of similar photos and proposes %d photos for review. It protects %d favorites, %d Live Photos and %d photos with people. Sum this up in one or two friendly sentences with these numbers only; nothing was deleted.", groups, reviewable, favorites, live, people)
