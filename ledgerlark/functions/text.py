"""String helpers: labels, URLs, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: display names of known providers
PROVIDER_NAMES = {
    "xai": "Advanced Research",
    "grok": "Advanced Research",
    "advanced_research": "Advanced Research",
    "gemini_ultra_lean": "Gemini Ultra Lean",
    "gemini_pro": "Gemini Pro Legacy",
    "gemini": "Gemini",
    "exa": "Exa",
    "perplexity": "Perplexity",
    "both": "Multi-provider",
}


def choose(col: Column, mapping: dict[str, str], otherwise: Column) -> Column:
    """CASE over literal keys."""
    out = None
    for key, value in mapping.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out.otherwise(otherwise)


def non_blank(col: Column) -> Column:
    """NULL when the text is NULL or only spaces."""
    return F.when(F.trim(col) != "", col)


def non_empty(col: Column) -> Column:
    """NULL when the text is ''."""
    return F.nullif(col, F.lit(""))


def provider_label(provider: Column) -> Column:
    """Known display name, 'Unknown' for blank, else separators to spaces and title case."""
    name = F.trim(F.coalesce(provider, F.lit("")))
    spaced = F.regexp_replace(name, r"[_\s-]+", " ")
    return choose(name, PROVIDER_NAMES, F.when(name == "", F.lit("Unknown")).otherwise(title_case(spaced)))


def title_case(text: Column) -> Column:
    """Letters after anything that is neither letter nor digit in upper case, all others in lower case."""
    parts = F.split(F.lower(text), r"(?<=[^\p{L}\p{N}])")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def normalize_profile_url(url: Column) -> Column:
    """Canonical `linkedin.com/in/...` or `linkedin.com/company/...`, NULL for any other URL."""
    clean = F.regexp_replace(F.lower(F.trim(url)), r"^(https?:)?//", "")
    clean = F.regexp_replace(clean, r"^[a-z0-9-]+\.linkedin\.com", "linkedin.com")
    clean = F.regexp_replace(F.regexp_replace(clean, r"[?#].*$", ""), r"/+$", "")
    return F.when(clean.rlike(r"^linkedin\.com/(in|company)/[a-z0-9_%.-]+"), clean)


def website_domain(site: Column) -> Column:
    """Host of a website without scheme, `www.` and path."""
    host = F.regexp_replace(site, r"^https?://", "")
    host = F.regexp_replace(host, r"^www\.", "")
    return F.regexp_replace(host, r"/.*$", "")


def first_name_of(name: Column) -> Column:
    return F.split_part(name, F.lit(" "), F.lit(1))


def last_name_of(name: Column) -> Column:
    parts = F.split(name, " ")
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), " ")
