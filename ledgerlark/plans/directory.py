"""Registered directory, ICP, settings and query-surface queries and their oracles."""

from pyspark.sql import functions as F

from ledgerlark.functions import stages as G
from ledgerlark.functions import text as X
from ledgerlark.functions.json import json_contains
from ledgerlark.operators import directory as D
from ledgerlark.operators import icp as I
from ledgerlark.operators import query as Q
from ledgerlark.operators import settings as S
from ledgerlark.plans.registry import query
from ledgerlark.session import work_dir
from ledgerlark.sources import io
from ledgerlark.sources.records import read_csv

# ---------------------------------------------------------------- query surface


@query(
    "query_where",
    """SELECT id, organization_id, name FROM contacts WHERE organization_id <> 'org_3' AND name ILIKE '%van last1%' AND pipeline_stage IN ('LEAD','CLOSED_WON','PROSPECT') AND email IS NOT NULL
      AND created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-30' AND do_not_contact IS NOT DISTINCT FROM NULL""",
)
def _where(t):
    rules = {
        "organization_id": ("neq", "org_3"), "name": ("ilike", "*van last1*"), "pipeline_stage": ("in", ["LEAD", "CLOSED_WON", "PROSPECT"]), "email": ("is", "not_null"),
        "created_at": [("gte", "2024-01-03"), ("lt", "2024-01-30")], "do_not_contact": ("is", None),
    }
    return Q.where(t.contacts, rules).select("id", "organization_id", "name")


@query("query_json_contains", """WITH j AS (SELECT id, TRY_CAST(metadata AS JSON) AS m FROM usage)
  SELECT id FROM j WHERE json_type(m -> '$.service') = 'VARCHAR' AND m ->> '$.service' = 'company_research' AND json_type(m -> '$.success') = 'BOOLEAN' AND m ->> '$.success' = 'true'""")
def _contains(t):
    return Q.where(t.usage, {"metadata": ("cs", {"service": "company_research", "success": True})}).select("id")


@query(
    "query_json_contains_typed",
    """WITH d AS (SELECT id, CAST(doc AS JSON) AS j FROM typed_documents),
    t AS (SELECT id, j, json_type(j -> '$.k') AS k, json_type(j -> '$.n.z') AS z, json_type(j -> '$.tags') AS tags FROM d)
    SELECT id, coalesce(k = 'VARCHAR' AND j ->> '$.k' = '1', FALSE) AS text_one, coalesce(k IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST(j ->> '$.k' AS DOUBLE) = 1, FALSE) AS number_one,
      coalesce(j ->> '$."a.b"' = 'x', FALSE) AS dotted, coalesce(z IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST(j ->> '$.n.z' AS DOUBLE) = 1, FALSE) AS nested,
      coalesce(tags = 'ARRAY' AND list_contains(CAST(from_json(j -> '$.tags', '["JSON"]') AS VARCHAR[]), '"crm"'), FALSE) AS item, coalesce(k = 'NULL', FALSE) AS none FROM t""",
)
def _contains_typed(t):
    asked = {"text_one": {"k": "1"}, "number_one": {"k": 1}, "dotted": {"a.b": "x"}, "nested": {"n": {"z": 1}}, "item": {"tags": ["crm"]}, "none": {"k": None}}
    return t.typed_documents.select("id", *[json_contains(F.col("doc"), w).alias(n) for n, w in asked.items()])


@query("query_array_contains", "SELECT id FROM companies WHERE list_contains(string_split(industry_text, ','), 'Energy')")
def _array(t):
    return Q.where(t.companies.withColumn("industries", F.split("industry_text", ",")), {"industries": ("cs", ["Energy"])}).select("id")


@query("query_page", "SELECT id, billed_cost FROM usage ORDER BY billed_cost DESC, id LIMIT 50 OFFSET 100")
def _page(t):
    return Q.page(t.usage, ["-billed_cost", "id"], 50, 100, ["id", "billed_cost"])


@query("query_order_by_json", "SELECT id, icp_score ->> '$.score' AS score FROM companies")
def _order_json(t):
    return Q.order_by_json(t.companies, "icp_score", "score").select("id", F.get_json_object("icp_score", "$.score").alias("score"))


# ---------------------------------------------------------------- lists

_BY_CAMPAIGN = """WITH m AS (SELECT c.* FROM companies c JOIN campaign_companies cc ON cc.company_id = c.id AND cc.organization_id = c.organization_id WHERE cc.campaign_id = 'camp_1' AND {cond})
SELECT id, name, created_at, (SELECT count(DISTINCT id) FROM m) AS total_count FROM m ORDER BY {order} LIMIT {limit}"""


@query("companies_by_campaign", _BY_CAMPAIGN.format(cond="TRUE", order="name, id", limit="5 OFFSET 5"))
def _by_campaign(t):
    return D.by_campaign(t.companies, t.campaign_companies, "camp_1", page=2, limit=5).select("id", "name", "created_at", "total_count")


@query(
    "companies_by_campaign_processed",
    _BY_CAMPAIGN.format(cond="(processing_status IN ('processed','approved','declined') OR c.blocked_by_icp) AND (name ILIKE '%supplier%' OR location ILIKE '%supplier%')", order="created_at DESC, name, id", limit="50"),
)
def _by_campaign_processed(t):
    return D.by_campaign(t.companies, t.campaign_companies, "camp_1", status="processed", search="supplier", sort_by="created_at", descending=True).select("id", "name", "created_at", "total_count")


@query("companies_size_values", "SELECT company_size, count(*) AS company_count FROM companies WHERE company_size IS NOT NULL GROUP BY 1")
def _sizes(t):
    return D.size_values(t.companies)


@query("companies_size_mismatch", "SELECT company_size, employee_count, count(*) AS companies FROM companies WHERE company_size IS NOT NULL GROUP BY 1, 2")
def _mismatch(t):
    return D.size_mismatch(t.companies)


@query("contacts_needing_email", "SELECT id, organization_id, name, created_at FROM contacts WHERE email IS NULL AND email_validation_response IS NULL")
def _needing(t):
    return D.needing_email(t.contacts).select("id", "organization_id", "name", "created_at")


_DOMAIN = """d AS (SELECT c.id AS contact_id, c.organization_id, first_name, last_name, f.id AS company_id, f.name AS company_name, website, regexp_replace(regexp_replace(regexp_replace(website, '^https?://', ''), '^www\\.', ''), '/.*$', '') AS extracted_domain,
  c.created_at, l.created_at AS linked_at FROM contacts c JOIN company_contacts l ON l.contact_id = c.id AND l.organization_id = c.organization_id JOIN companies f ON f.id = l.company_id AND f.organization_id = c.organization_id
  WHERE email IS NULL AND email_validation_response IS NULL AND first_name <> '' AND last_name <> '' AND website <> '')"""


@query("contacts_needing_email_with_domain", f"WITH {_DOMAIN} SELECT * FROM d")
def _needing_domain(t):
    return D.needing_email_with_domain(t.contacts, t.company_contacts, t.companies)


@query("contacts_domain_distribution", f"WITH {_DOMAIN} SELECT extracted_domain, count(*) AS contact_count FROM d GROUP BY 1")
def _domains(t):
    return D.domain_distribution(t.contacts, t.company_contacts, t.companies)


_EXPORT = """WITH b AS (SELECT l.organization_id, l.contact_id, f.name, f.website, f.profile_url, f.location, f.phone, f.specialities FROM company_contacts l LEFT JOIN companies f ON f.id = l.company_id AND f.organization_id = l.organization_id
      QUALIFY row_number() OVER (PARTITION BY l.organization_id, l.contact_id ORDER BY CASE WHEN f.id IS NULL THEN 1 ELSE 0 END, CASE WHEN f.name <> '' THEN 0 ELSE 1 END, l.created_at DESC NULLS LAST, l.company_id) = 1)
    SELECT c.id, c.organization_id, coalesce(first_name, split_part(c.name, ' ', 1), '') AS first_name, coalesce(last_name, array_to_string(string_split(c.name, ' ')[2:], ' '), '') AS last_name, coalesce(job_title, '') AS title,
      coalesce(b.name, '') AS company_name, coalesce(b.website, '') AS company_website, coalesce(c.profile_url, '') AS personal_profile, coalesce(b.profile_url, '') AS company_profile, '' AS company_email, coalesce(email, '') AS personal_email,
      coalesce(c.phone, '') AS mobile_number, coalesce(b.phone, '') AS company_number,
      coalesce(TRY_CAST(c.location AS JSON) ->> '$.city', TRY_CAST(c.location AS JSON) ->> '$.default', TRY_CAST(c.location AS JSON) ->> '$.country', '') AS person_location, coalesce(b.location, '') AS company_location, coalesce(pipeline_stage, 'PROSPECT') AS stage,
      coalesce(array_to_string(from_json(skills, '["VARCHAR"]'), ', '), array_to_string(from_json(b.specialities, '["VARCHAR"]'), ', '), '') AS technologies
    FROM contacts c LEFT JOIN b ON b.contact_id = c.id AND b.organization_id = c.organization_id"""


@query("contacts_export_template", _EXPORT)
def _export(t):
    return D.export_template(t.contacts, t.company_contacts, t.companies)


_SENT = ("first_name", "last_name", "title", "company_name", "personal_email", "stage", "technologies")


@query(
    "contacts_csv_round_trip",
    f"SELECT id, {', '.join(f"nullif({c}, '') AS {c}" for c in _SENT)}, 'of ' || id || chr(10) || 'says \"' || first_name || '\",' AS note FROM ({_EXPORT})",
)
def _round_trip(t):
    """The export written as CSV, with line breaks and quotes in a note, and read again."""
    rows = _export(t).select("id", *_SENT, F.concat(F.lit("of "), "id", F.lit('\nsays "'), "first_name", F.lit('",')).alias("note"))
    folder = work_dir(t.spark, "export")
    io.write_contact_export(rows, folder)
    return read_csv(t.spark, folder)


# ---------------------------------------------------------------- ICP


@query(
    "icp_blocked_detail",
    """SELECT id, organization_id, name, created_at, processing_log ->> '$.final_status' AS final_status,
      CASE WHEN processing_log IS NOT NULL THEN array_to_string(flatten(list_transform(list_filter(from_json(processing_log -> '$.steps', '[{"step":"VARCHAR","data":{"failed_filters":["VARCHAR"]}}]'), lambda s: s.step IN ('icp_scoring','early_block_check')), lambda s: s.data.failed_filters)), ',') END AS log_filters,
      array_to_string(from_json(icp_score -> '$.llm_analysis.failed_filters', '["VARCHAR"]'), ',') AS score_filters, array_to_string(from_json(icp_score -> '$.reasoning.failed_hard_filters', '["VARCHAR"]'), ',') AS reasoning_filters,
      icp_score ->> '$.reasoning.hard_filter_failed' AS hard_filter_failed
    FROM companies WHERE blocked_by_icp ORDER BY created_at DESC, id LIMIT 20""",
)
def _detail(t):
    joined = lambda c: F.array_join(c, ",")
    return I.blocked_detail(t.companies, 20).select(
        "id", "organization_id", "name", "created_at", "final_status", joined("failed_filters_from_log").alias("log_filters"),
        joined("failed_filters_from_score").alias("score_filters"), joined("failed_filters_from_reasoning").alias("reasoning_filters"), "hard_filter_failed",
    )


@query(
    "icp_blocking_reasons",
    """WITH r AS (SELECT unnest(coalesce(from_json(icp_score -> '$.llm_analysis.failed_filters', '["VARCHAR"]'), from_json(icp_score -> '$.reasoning.failed_hard_filters', '["VARCHAR"]'), [icp_score ->> '$.reasoning.hard_filter_failed'])) AS failed_filter FROM companies WHERE blocked_by_icp)
    SELECT failed_filter, count(*) AS blocked_count FROM r WHERE failed_filter IS NOT NULL GROUP BY 1""",
)
def _reasons(t):
    return I.blocking_reasons(t.companies)


@query("icp_reset_blocking", "SELECT id, icp_profile_id = 'icp_1' AND blocked_by_icp AS was_reset, CASE WHEN icp_profile_id = 'icp_1' THEN FALSE ELSE blocked_by_icp END AS blocked_by_icp FROM campaign_companies")
def _reset(t):
    return I.reset_blocking(t.campaign_companies, "icp_1").select("id", "was_reset", "blocked_by_icp")


@query(
    "icp_default_profiles",
    "SELECT id AS organization_id, 'Default Profile' AS name, TRUE AS is_default FROM workspaces w WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM icp_settings_rows s WHERE s.organization_id = w.id AND icp_settings IS NOT NULL)",
)
def _profiles(t):
    return I.default_profiles(t.workspaces, t.icp_settings_rows.filter(F.col("icp_settings").isNotNull())).select("organization_id", "name", "is_default")


@query(
    "icp_company_analytics",
    """SELECT c.id, c.organization_id, c.name, employee_count, processing_status, c.created_at, CAST(icp_component_scores ->> '$.industry_fit' AS DECIMAL(18,6)) AS industry_fit_score, CAST(icp_component_scores ->> '$.strategic_value' AS DECIMAL(18,6)) AS strategic_value_score,
      research_modules ->> '$.company_overview.summary' AS company_overview_summary, research_modules ->> '$.growth_signals.summary' AS growth_signals_summary,
      coalesce(array_to_string(from_json(research_modules -> '$.company_overview.key_findings', '["VARCHAR"]'), ','), '') AS findings, (SELECT count(*) FROM company_contacts l WHERE l.company_id = c.id AND l.organization_id = c.organization_id) AS total_contacts
    FROM companies c""",
)
def _company_analytics(t):
    return I.company_analytics(t.companies, t.company_contacts).select(
        "id", "organization_id", "name", "employee_count", "processing_status", "created_at", "industry_fit_score", "strategic_value_score", "company_overview_summary", "growth_signals_summary",
        F.array_join("company_overview_key_findings", ",").alias("findings"), "total_contacts",
    )


@query(
    "icp_contact_analytics",
    """WITH l AS (SELECT * FROM company_contacts QUALIFY row_number() OVER (PARTITION BY organization_id, contact_id ORDER BY created_at DESC NULLS LAST, company_id DESC) = 1)
    SELECT c.id, l.company_id, CAST(ocean_traits ->> '$.openness' AS DECIMAL(18,6)) AS openness_score, CAST(ocean_traits ->> '$.emotionalStability' AS DECIMAL(18,6)) AS emotional_stability_score, CAST(disc_traits ->> '$.dominance' AS DECIMAL(18,6)) AS dominance_score,
      f.name AS company_name, f.employee_count AS company_employee_count
    FROM contacts c LEFT JOIN l ON l.contact_id = c.id AND l.organization_id = c.organization_id LEFT JOIN companies f ON f.id = l.company_id AND f.organization_id = l.organization_id""",
)
def _contact_analytics(t):
    return I.contact_analytics(t.contacts, t.company_contacts, t.companies).select(
        "id", "company_id", "openness_score", "emotional_stability_score", "dominance_score", "company_name", "company_employee_count"
    )


# ---------------------------------------------------------------- scalar rules


@query(
    "rules_contacts",
    """SELECT id, CASE WHEN coalesce(trim(split_part(name, ' ', 1)), '') = '' THEN '' ELSE split_part(name, ' ', 1) END AS first_word, array_to_string(string_split(name, ' ')[2:], ' ') AS rest,
      CASE upper(pipeline_stage) WHEN 'LEAD' THEN 1 WHEN 'REENGAGEMENT' THEN 1 WHEN 'APPOINTMENT_REQUESTED' THEN 2 WHEN 'APPOINTMENT_CANCELLED' THEN 2 WHEN 'APPOINTMENT_SCHEDULED' THEN 3 WHEN 'PRESENTATION_SCHEDULED' THEN 4
        WHEN 'CONTRACT_NEGOTIATIONS' THEN 5 WHEN 'AGREEMENT_IN_PRINCIPLE' THEN 6 WHEN 'CLOSED_LOST' THEN 0 WHEN 'NOT_INTERESTED' THEN 0 ELSE -1 END AS stage_level,
      round(coalesce(coalesce(fit_score * 0.4, 0) + CASE WHEN profile_url IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN research IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN skills IS NOT NULL THEN 5 ELSE 0 END
        + CASE WHEN social_score > 50 THEN 10 ELSE social_score * 0.2 END, 0), 6) AS lead_quality, coalesce(assigned_to_user_id, 'owner') AS assignee
    FROM contacts""",
)
def _rules_contacts(t):
    score = G.lead_quality_score(
        F.col("fit_score"), F.lit(None).cast("double"), F.col("profile_url").isNotNull(), F.col("research").isNotNull(), F.col("skills").isNotNull(), F.lit(False), F.col("social_score")
    )
    return t.contacts.select(
        "id", X.first_name_of(F.col("name")).alias("first_word"), X.last_name_of(F.col("name")).alias("rest"), G.deal_stage_level(G.stage_to_deal_stage(F.col("pipeline_stage"))).alias("stage_level"),
        F.round(score, 6).alias("lead_quality"), G.default_assignee(F.col("assigned_to_user_id"), F.lit("owner")).alias("assignee"),
    )


@query(
    "rules_companies",
    """SELECT id, CASE WHEN processing_status IN ('approved','processed','failed','cancelled') THEN processing_status WHEN processing_status IN ('pending','scheduled','processing') THEN 'processing' WHEN processing_status = 'blocked_by_icp' THEN 'blocked' END AS simple_status,
      CASE WHEN manually_unblocked THEN FALSE WHEN icp_score IS NULL THEN blocked_by_icp ELSE coalesce(icp_score ->> '$.blocked' = 'true', FALSE) OR coalesce(icp_score ->> '$.llm_analysis.blocked' = 'true', FALSE) END AS blocked,
      CASE WHEN icp_score IS NULL THEN 'none' WHEN CAST(icp_score ->> '$.score' AS INT) >= 80 THEN 'Tier 1' WHEN CAST(icp_score ->> '$.score' AS INT) >= 60 THEN 'Tier 2' ELSE 'Tier 3' END AS tier,
      CASE company_size WHEN '1-10' THEN 1 WHEN '11-50' THEN 2 WHEN '51-200' THEN 4 ELSE 3 END AS rank
    FROM companies""",
)
def _rules_companies(t):
    size_as_priority = F.when(F.col("company_size") == "1-10", "urgent").when(F.col("company_size") == "11-50", "high").when(F.col("company_size") == "51-200", "low")
    return t.companies.select(
        "id", G.simple_status(F.col("processing_status")).alias("simple_status"), G.blocked_by_icp(F.col("blocked_by_icp"), F.col("icp_score"), F.col("manually_unblocked")).alias("blocked"),
        G.icp_tier(F.get_json_object("icp_score", "$.score").cast("int"), F.lit("none")).alias("tier"), G.priority_rank(size_as_priority).alias("rank"),
    )


# ---------------------------------------------------------------- settings and style


def _texts(path: str) -> str:
    return f"CASE WHEN json_type(s -> '{path}') = 'ARRAY' THEN array_to_string(from_json(s -> '{path}', '[\"VARCHAR\"]'), ',') ELSE '' END"


_JSON = "j AS (SELECT organization_id, CAST(icp_settings AS JSON) AS s FROM icp_settings_rows)"


@query(
    "settings_flatten_icp",
    f"""WITH {_JSON} SELECT organization_id, coalesce(CAST(s ->> '$.company_criteria.company_size.min_employees' AS INT), 11) AS icp_min_employees, coalesce(CAST(s ->> '$.company_criteria.company_size.max_employees' AS INT), 500) AS icp_max_employees,
      {_texts('$.company_criteria.sales_process')} AS icp_sales_process, CASE WHEN json_type(s -> '$.industries') = 'OBJECT' THEN array_to_string(json_keys(s -> '$.industries'), ',') ELSE {_texts('$.industries')} END AS icp_industries,
      {_texts('$.preferred_job_titles')} AS icp_job_titles, {_texts('$.geography.primary_regions')} AS icp_primary_regions, {_texts('$.geography.secondary_regions')} AS icp_secondary_regions,
      {_texts('$.geography.focus_areas')} AS icp_focus_areas, {_texts('$.pain_points')} AS icp_pain_points FROM j""",
)
def _flatten(t):
    out = S.flatten_icp(t.icp_settings_rows).drop("icp_settings")
    return out.select(*(F.array_join(c, ",").alias(c) if out.schema[c].dataType.typeName() == "array" else F.col(c) for c in out.columns))


@query(
    "settings_icp_urls",
    f"""WITH {_JSON}, u AS (SELECT organization_id, unnest(from_json(s -> '$.current_customers', '["VARCHAR"]')) AS url, 'current_customer' AS url_type FROM j UNION ALL SELECT organization_id, unnest(from_json(s -> '$.ideal_customers', '["VARCHAR"]')), 'ideal_customer' FROM j
      UNION ALL SELECT organization_id, unnest(from_json(s -> '$.ideal_persons', '["VARCHAR"]')), 'ideal_person' FROM j UNION ALL SELECT organization_id, unnest(from_json(s -> '$.exclusion_list', '["VARCHAR"]')), 'exclusion' FROM j)
    SELECT DISTINCT * FROM u""",
)
def _urls(t):
    return S.icp_urls(t.icp_settings_rows)


@query(
    "settings_split_profile_urls",
    f"""WITH {_JSON}, f AS (SELECT organization_id, s, json_type(s -> '$.ideal_clients') AS has FROM j)
    SELECT organization_id, CASE WHEN has IS NOT NULL THEN array_to_string(list_filter(from_json(s -> '$.ideal_clients', '["VARCHAR"]'), lambda u: contains(u, '/company/')), ',') ELSE array_to_string(from_json(s -> '$.ideal_customers', '["VARCHAR"]'), ',') END AS ideal_customers,
      CASE WHEN has IS NOT NULL THEN array_to_string(list_filter(from_json(s -> '$.ideal_clients', '["VARCHAR"]'), lambda u: contains(u, '/in/') AND NOT contains(u, '/company/')), ',') ELSE array_to_string(from_json(s -> '$.ideal_persons', '["VARCHAR"]'), ',') END AS ideal_persons,
      array_to_string(list_filter(from_json(s -> '$.current_customers', '["VARCHAR"]'), lambda u: contains(u, '/company/')), ',') AS current_customers, CASE WHEN json_type(s -> '$.industries') IN ('ARRAY', 'OBJECT') THEN NULL ELSE s ->> '$.industries' END AS text_industries
    FROM f""",
)
def _split(t):
    rows = S.split_profile_urls(t.icp_settings_rows)
    joined = lambda k: F.array_join(F.from_json(F.get_json_object("icp_settings", f"$.{k}"), "array<string>"), ",").alias(k)
    industries = F.get_json_object("icp_settings", "$.industries")
    return rows.select("organization_id", joined("ideal_customers"), joined("ideal_persons"), joined("current_customers"), F.when(~industries.rlike(r"^[\[{]"), industries).alias("text_industries"))


def _lex(name: str, keys: str) -> str:
    parts = " || ".join(f"coalesce(from_json(lexical_fields -> '$.{k}', '[\"VARCHAR\"]'), [])" for k in keys.split())
    return f"array_to_string({parts}, ',') AS {name}"


@query(
    "style_clean_categories",
    f"""SELECT id, {_lex('industry_specific', 'industry_specific farm_agrarian natural_environment')}, {_lex('customer_experience', 'customer_experience activity_fun group_experience social_leisure')}, {_lex('brand_identity', 'brand_identity rural_locale')},
      {_lex('value_proposition', 'value_proposition')}, array_to_string(list_transform(from_json(dictionary, '[{{"term":"VARCHAR","category":"VARCHAR"}}]'), lambda e: CASE
        WHEN e.category IN ('General Terms','Product Features','Customer Benefits','Industry Terms','Value Propositions','Technical Terms','Business Terms') THEN e.category
        WHEN e.category ILIKE '%product%' OR e.category ILIKE '%feature%' THEN 'Product Features' WHEN e.category ILIKE '%customer%' OR e.category ILIKE '%benefit%' THEN 'Customer Benefits' WHEN e.category ILIKE '%industry%' OR e.category ILIKE '%business%' THEN 'Industry Terms'
        WHEN e.category ILIKE '%tech%' THEN 'Technical Terms' WHEN e.category ILIKE '%value%' OR e.category ILIKE '%proposition%' THEN 'Value Propositions' ELSE 'General Terms' END), ',') AS categories
    FROM style_guidelines""",
)
def _clean(t):
    fields = F.from_json("lexical_fields", S.LEXICAL)
    lex = lambda k: F.coalesce(F.array_join(fields[k], ","), F.lit("")).alias(k)
    categories = F.array_join(F.transform(F.from_json("dictionary", S.DICTIONARY), lambda e: e["category"]), ",")
    return S.clean_categories(t.style_guidelines).select("id", lex("industry_specific"), lex("customer_experience"), lex("brand_identity"), lex("value_proposition"), categories.alias("categories"))


@query(
    "style_simplify",
    """SELECT id, array_to_string(list_sort(list_distinct(coalesce(string_split(emotions_text, ','), []) || coalesce(string_split(traits_text, ','), []))), ',') AS tone_attributes,
      array_to_string(list_sort(list_distinct(coalesce(flatten(map_values(CAST(CAST(lexical_fields AS JSON) AS MAP(VARCHAR, VARCHAR[])))), []))), ',') AS key_phrases,
      array_to_string(list_sort(list_distinct(coalesce(list_transform(list_filter(from_json(dictionary, '[{"term":"VARCHAR","category":"VARCHAR"}]'), lambda e: e.category IN ('avoid','negative','do_not_use')), lambda e: e.term), []))), ',') AS avoid_phrases
    FROM style_guidelines""",
)
def _simplify(t):
    rows = t.style_guidelines.withColumns({"emotions": F.split("emotions_text", ","), "traits": F.split("traits_text", ",")})
    out = S.simplify(rows)
    return out.select("id", *(F.array_join(c, ",").alias(c) for c in ("tone_attributes", "key_phrases", "avoid_phrases")))
