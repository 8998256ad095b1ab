"""Text expressions: cleaning, canonical names, hashes, language vote and mention mining.

White space, letters and word boundaries are Unicode-aware throughout. Patterns spell the classes
out instead of relying on a regex engine's ASCII defaults.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliowire import domain
from foliowire.functions.scoring import lookup

# White space as Unicode (and the four separator controls) defines it.
SPACE = "\\s\\x0B\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
WORD = "\\p{L}\\p{N}_"


def full_text(title: Column, summary: Column, content: Column) -> Column:
    """Title, summary and content as sentences, without dots and blanks at either end."""
    parts = [F.coalesce(c, F.lit("")) for c in (title, summary, content)]
    joined = F.concat(parts[0], F.lit(". "), parts[1], F.lit(". "), parts[2])
    return F.btrim(joined, F.lit(". "))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def clean(text: Column) -> Column:
    """Drop tags, then links, then collapse white space."""
    no_tags = F.regexp_replace(text, "<[^>]+>", " ")
    no_links = F.regexp_replace(no_tags, f"https?://[^{SPACE}]+", "")
    return squeeze(no_links)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda t: t != "")


def vote_language(text: Column, sample: int = 50, needed: int = 5) -> Column:
    """'es' when more than ``needed`` of the first ``sample`` tokens are Spanish stop words, else 'en'."""
    head = F.slice(tokens(F.lower(text)), 1, sample)
    hits = F.size(F.filter(head, lambda w: w.isin(*domain.SPANISH_STOP_WORDS)))
    return F.when(hits > needed, "es").otherwise("en")


def capitalised_runs(text: Column) -> Column:
    """All runs of two or more capitalised words, in order of appearance; a run may be as long as its text.

    The repetitions are possessive: they lose no run, because a word of a run ends at a boundary or at white space, and the engine
    goes through them in a loop. A group that may give back words takes some of the task's stack for every word.
    """
    pattern = f"(?U)(?=[A-Z])\\b([A-Z][a-z]++(?:[{SPACE}]++[A-Z][a-z]++\\b)++)"  # the first look at a character is the cheap one
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def mined_organisations(text: Column | str, top: int | None = 10, squeezed: bool = False) -> Column:
    """Distinct capitalised runs, those opening with a stop word removed, at most ``top`` of them; None takes all.

    ``squeezed`` finds what a text with collapsed white space holds, collapsing it in the runs only.
    """
    def opening(run):
        return F.element_at(F.split(run, f"[{SPACE}]+"), 1)

    runs = capitalised_runs(text)
    distinct = F.array_distinct(F.transform(runs, lambda run: F.regexp_replace(run, f"[{SPACE}]+", " ")) if squeezed else runs)
    wanted = F.filter(distinct, lambda run: ~opening(run).isin(*domain.ORG_STOP_FIRST_WORDS))
    return wanted if top is None else F.slice(wanted, 1, top)


@lru_cache(maxsize=1)
def _accent_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition without combining marks, tabulated by rule for alphabetic blocks."""
    blocks = ((0xA0, 0x24F), (0x370, 0x3FF), (0x400, 0x4FF), (0x1E00, 0x1FFF), (0x2000, 0x206F),
              (0x2100, 0x214F), (0xFB00, 0xFB06), (0xFF01, 0xFF5E))
    source, target, expanded = [], [], {}
    for low, high in blocks:
        for code in range(low, high + 1):
            char = chr(code)
            bare = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if bare == char:
                continue
            if len(bare) == 1:
                source.append(char)
                target.append(bare)
            else:
                expanded[char] = bare
    return "".join(source), "".join(target), expanded


def accent_table() -> dict[str, str]:
    """What ``strip_accents`` makes of each character that it replaces."""
    source, target, expanded = _accent_tables()
    return dict(zip(source, target, strict=True)) | expanded


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_accents(text: Column) -> Column:
    """Letters without their diacritics (compatibility forms folded as well).

    The rarer steps run only where something non-ASCII is left after the common letters are folded.
    """
    source, target, expanded = _accent_tables()
    listed = "\x01".join(f"{c}\x02{bare}" for c, bare in expanded.items())

    def rare(folded):
        table = F.str_to_map(F.lit(listed), F.lit("\x01"), F.lit("\x02"))
        several = F.array_join(F.transform(F.split(folded, ""), lambda c: F.coalesce(table[c], c)), "")
        spread = F.when(F.rlike(folded, F.lit("[" + "".join(expanded) + "]")), several).otherwise(folded)
        return F.regexp_replace(spread, "[\\p{Mn}\\p{Me}]", "")

    return bind(F.translate(text, source, target), lambda t: F.when(is_ascii(t), t).otherwise(rare(t)))


def _words(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    def split(t):
        return F.when(is_ascii(t), F.split(t, "[^a-zA-Z0-9_]+")).otherwise(F.split(t, f"[^{WORD}]+"))

    return F.filter(bind(text, split), lambda w: w != "")


def canonical_name(name: Column) -> Column:
    """Company name in lower case without accents, punctuation and legal-form words."""
    base = F.replace(strip_accents(F.lower(F.coalesce(name, F.lit("")))), F.lit("."), F.lit(""))
    return F.array_join(F.filter(_words(base), lambda w: ~w.isin(*domain.CORPORATE_SUFFIXES)), " ")


def name_root(canonical: Column) -> Column:
    """First word of a canonical name."""
    return F.element_at(F.split(canonical, " "), 1)


def match_words(text: Column) -> Column:
    """Words of a text as mentions are compared: lower case, no accents, punctuation split off."""
    return _words(strip_accents(F.lower(text)))


def match_text(text: Column) -> Column:
    """The words of ``match_words`` in one string with a blank on either side."""
    return F.concat(F.lit(" "), F.array_join(match_words(text), " "), F.lit(" "))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by blanks, missing parts counting as empty."""
    return F.sha2(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def pretty_label(label: Column) -> Column:
    """Underscores to blanks, each word's first letter in upper case."""
    words = F.split(F.replace(label, F.lit("_"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def age_label(ts: Column, as_of: Column) -> Column:
    """Relative age of a timestamp in minutes, hours or days; the date itself from a week on."""
    seconds = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))
    minutes = F.floor(seconds / 60)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(ts.isNull(), "")
        .when(minutes < 1, "Ahora")
        .when(minutes < 60, F.concat(F.lit("Hace "), minutes, F.lit("m")))
        .when(hours < 24, F.concat(F.lit("Hace "), hours, F.lit("h")))
        .when(days < 7, F.concat(F.lit("Hace "), days, F.lit("d")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm"))
    )


def event_date(value: Column) -> Column:
    """Calendar date of an ISO timestamp string; null when it cannot be read."""
    iso = F.regexp_extract(value, "^\\d{4}-\\d{2}-\\d{2}([T ]\\d{2}(:\\d{2}){0,2}(\\.\\d+)?(Z|[+-]\\d{2}:?\\d{2})?)?$", 0)
    return F.when(iso != "", F.substring(value, 1, 10).try_cast("date"))


def asset_description(name: Column, ticker: Column, *more: Column) -> Column:
    """Non-empty parts of an asset's description, comma separated."""
    parts = [F.when(p != "", p) for p in (name, ticker, *more)]
    return F.concat_ws(", ", *parts)


def filled(template: str, *parts: Column) -> Column:
    """A message text with its numbered gaps filled by columns."""
    pieces = re.split(r"\{(\d+)\}", template)
    return F.concat(F.lit(""), *[parts[int(p)].cast("string") if k % 2 else F.lit(p) for k, p in enumerate(pieces) if k % 2 or p])


def alert_explanation(title, assets, event_type, direction, severity, confidence, relevance, source, sentiment,
                      supplied=None) -> Column:
    """Sentence-by-sentence explanation of an alert; a supplied explanation takes precedence."""
    texts = domain.EXPLANATION_TEXTS
    named = F.when(F.size(assets) > 0, F.array_join(assets, ", ")).otherwise(texts["no_assets"])
    event = lookup(event_type, domain.EVENT_TEXT, event_type)
    why = F.when(relevance >= 0.8, texts["direct"]).when(relevance >= 0.5, texts["semantic"]).otherwise(texts["indirect"])
    mood = F.when(sentiment != "neutral", filled(texts["mood"], sentiment))
    two = F.format_string("%.2f", confidence)
    built = F.concat_ws(
        " ", filled(texts["alert"], direction, severity, named), filled(texts["event"], event),
        filled(texts["relevance"], F.concat_ws("; ", why, mood)), filled(texts["confidence"], two), filled(texts["source"], source))
    if supplied is None:
        return built
    extended = filled(texts["supplied"], F.rtrim(supplied, F.lit(".")), two, source)
    return F.when(supplied.isNotNull() & (supplied != ""), extended).otherwise(built)


def alert_subject(severity: Column, direction: Column, assets: Column) -> Column:
    icon = lookup(severity, domain.SEVERITY_ICON, F.lit(domain.DEFAULT_ICON))
    named = F.when(F.size(assets) > 0, F.array_join(assets, ", ")).otherwise(domain.SUBJECT_NO_ASSETS)
    return filled(domain.SUBJECT_TEXT, icon, direction, severity, named)


def alert_body(alert: dict[str, Column]) -> Column:
    """Plain-text message of an alert, one fact per line."""
    two = "%.2f"
    facts = (alert["title"], alert["direction"], alert["severity_label"], F.format_string(two, alert["severity"]), F.format_string(two, alert["confidence"]),
             F.array_join(alert["assets"], ", "), alert["event_type"], alert["sentiment"], alert["explanation"], alert["source"], alert["url"])
    return F.concat_ws("\n", *[filled(line, *facts) for line in domain.BODY_LINES])
