"""Workspace settings and style guidelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.json import json_set, json_strings

ORG = "organization_id"
MIN_EMPLOYEES, MAX_EMPLOYEES = 11, 500
URL_LISTS = {"current_customers": "current_customer", "ideal_customers": "ideal_customer", "ideal_persons": "ideal_person", "exclusion_list": "exclusion"}


def _list(path: str, keys_of_object: bool = False) -> Column:
    """Text array at a JSON path; an object gives its keys when asked; anything else is empty."""
    raw = F.get_json_object("icp_settings", path)
    out = F.when(raw.startswith("["), json_strings(raw))
    if keys_of_object:
        out = F.coalesce(out, F.when(raw.startswith("{"), F.json_object_keys(raw)))
    return F.coalesce(out, F.array().cast("array<string>"))


def flatten_icp(settings: DataFrame) -> DataFrame:
    """Nested profile JSON -> columns, with the default employee range."""
    size = lambda k, default: F.coalesce(F.get_json_object("icp_settings", f"$.company_criteria.company_size.{k}").try_cast("int"), F.lit(default))
    return settings.withColumns(
        {
            "icp_min_employees": size("min_employees", MIN_EMPLOYEES),
            "icp_max_employees": size("max_employees", MAX_EMPLOYEES),
            "icp_sales_process": _list("$.company_criteria.sales_process"),
            "icp_industries": _list("$.industries", keys_of_object=True),
            "icp_job_titles": _list("$.preferred_job_titles"),
            "icp_primary_regions": _list("$.geography.primary_regions"),
            "icp_secondary_regions": _list("$.geography.secondary_regions"),
            "icp_focus_areas": _list("$.geography.focus_areas"),
            "icp_pain_points": _list("$.pain_points"),
        }
    )


def icp_urls(settings: DataFrame) -> DataFrame:
    """Profile URLs of the four lists as distinct (workspace, url, type) rows."""

    def typed_urls(key: str, kind: str) -> Column:
        return F.transform(_list(f"$.{key}"), lambda u: F.struct(u.alias("url"), F.lit(kind).alias("url_type")))

    typed = [typed_urls(key, kind) for key, kind in URL_LISTS.items()]
    return settings.select(ORG, F.explode(F.concat(*typed)).alias("u")).select(ORG, "u.*").distinct()


def _json_array(items: Column) -> Column:
    return F.to_json(items)


def split_profile_urls(settings: DataFrame) -> DataFrame:
    """Split `ideal_clients` into company and person URLs, keep company URLs among current customers,
    and add the empty lists a newer reader expects."""
    is_company = lambda u: u.contains("/company/")
    clients = _list("$.ideal_clients")
    has = lambda k: F.get_json_object("icp_settings", f"$.{k}").isNotNull()
    entries = F.try_variant_get(F.try_parse_json("icp_settings"), "$", "map<string,variant>")
    firms = _json_array(F.filter(clients, is_company))
    people = _json_array(F.filter(clients, lambda u: ~is_company(u) & u.contains("/in/")))
    # as JSON, whatever the value's type
    keep = lambda k: F.coalesce(F.to_json(F.try_element_at(entries, F.lit(k))), F.lit("[]"))
    split = json_set(F.col("icp_settings"), {}, {"ideal_customers": firms, "ideal_persons": people, "industries": keep("industries"), "preferred_job_titles": keep("preferred_job_titles")})
    customers = _json_array(F.filter(_list("$.current_customers"), is_company))
    cleaned = json_set(F.col("icp_settings"), {}, {"current_customers": customers})
    rows = settings.withColumn("icp_settings", F.when(has("ideal_clients"), split).otherwise(F.col("icp_settings")))
    return rows.withColumn("icp_settings", F.when(has("current_customers"), cleaned).otherwise(F.col("icp_settings")))


# ---- style guidelines ---------------------------------------------------------------------

# fixed values: allowed categories, and old keys that move into one of them
LEXICAL_CATEGORIES = (
    "brand_identity", "product_service", "customer_experience", "professional_tone", "industry_specific",
    "value_proposition", "communication_style", "business_growth", "innovation_technology",
)
LEXICAL_MOVES = {
    "industry_specific": ("farm_agrarian", "natural_environment"),
    "brand_identity": ("rural_locale",),
    "customer_experience": ("activity_fun", "group_experience", "social_leisure"),
    "communication_style": ("action_movement", "dynamic_energy", "fun_engagement"),
}
DICTIONARY_CATEGORIES = (
    "General Terms", "Product Features", "Customer Benefits", "Industry Terms", "Value Propositions", "Technical Terms", "Business Terms",
)
CATEGORY_WORDS = (
    ("Product Features", ("product", "feature")),
    ("Customer Benefits", ("customer", "benefit")),
    ("Industry Terms", ("industry", "business")),
    ("Technical Terms", ("tech",)),
    ("Value Propositions", ("value", "proposition")),
)
AVOID_CATEGORIES = ("avoid", "negative", "do_not_use")
LEXICAL = "map<string,array<string>>"
DICTIONARY = "array<struct<term: string, category: string>>"


def _category(category: Column) -> Column:
    out = F.lit("General Terms")
    for name, words in reversed(CATEGORY_WORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | category.ilike(f"%{w}%")
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.when(category.isin(*DICTIONARY_CATEGORIES), category).otherwise(out)


def clean_categories(styles: DataFrame) -> DataFrame:
    """Move old lexical keys into the allowed categories, drop unknown ones, and remap the
    categories of dictionary entries by keyword."""
    fields = F.from_json("lexical_fields", LEXICAL)
    nothing = F.array().cast("array<string>")
    entries = []
    for name in LEXICAL_CATEGORIES:
        words = F.concat(*(F.coalesce(fields[k], nothing) for k in (name, *LEXICAL_MOVES.get(name, ()))))
        entries.append(F.when(F.size(words) > 0, F.struct(F.lit(name).alias("key"), words.alias("value"))))
    terms = F.transform(F.from_json("dictionary", DICTIONARY), lambda e: F.struct(e["term"].alias("term"), _category(e["category"]).alias("category")))
    return styles.withColumns(
        {
            "lexical_fields": F.when(F.col("lexical_fields").isNotNull(), F.to_json(F.map_from_entries(F.array_compact(F.array(*entries))))),
            "dictionary": F.to_json(terms),
        }
    )


def simplify(styles: DataFrame) -> DataFrame:
    """Flat style columns: tone attributes, key phrases and phrases to avoid, each distinct and sorted."""
    nothing = F.array().cast("array<string>")
    distinct = lambda a: F.array_sort(F.array_distinct(F.array_compact(a)))
    avoid = F.filter(F.from_json("dictionary", DICTIONARY), lambda e: e["category"].isin(*AVOID_CATEGORIES))
    return styles.withColumns(
        {
            "tone_attributes": distinct(F.concat(F.coalesce("emotions", nothing), F.coalesce("traits", nothing))),
            "key_phrases": distinct(F.coalesce(F.flatten(F.map_values(F.from_json("lexical_fields", LEXICAL))), nothing)),
            "avoid_phrases": distinct(F.coalesce(F.transform(avoid, lambda e: e["term"]), nothing)),
        }
    )
