"""CRM-shaped tables derived from the generic driver tables.

Each entry is one SELECT that means the same in Spark SQL and in ANSI SQL: `||`, CASE, `%`,
casts and interval arithmetic only. `{name}` stands for another table, `{{`/`}}` for braces.
The oracles share this text and nothing else.
"""

from __future__ import annotations

import string

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _org(expr: str) -> str:
    return f"('org_' || {_s(f'({expr}) % 4')})"


def _day(expr: str, unit: str = "HOUR") -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + ({expr}) * INTERVAL '1' {unit})"


# ---------------------------------------------------------------- organisations and people

ORGANIZATION = """
SELECT 'org_' || CAST(r_regionkey AS STRING) AS id,
       'Workspace ' || r_name AS name,
       r_regionkey = 4 AS deleted,
       CASE WHEN r_regionkey = 1 THEN 'restricted' ELSE 'full' END AS work_access_mode,
       CASE WHEN r_regionkey = 1 THEN 'overdue' END AS work_access_reason,
       CASE WHEN r_regionkey = 1 THEN TIMESTAMP '2024-03-01 00:00:00' END AS work_access_until,
       CASE WHEN r_regionkey = 2 THEN TRUE WHEN r_regionkey = 3 THEN FALSE END AS dispatch_suspended
FROM {region}
"""

ORGANIZATION_SETTINGS = """
SELECT 'org_' || CAST(r_regionkey AS STRING) AS organization_id,
       CASE WHEN r_regionkey <> 3 THEN CAST(1000 * (r_regionkey + 1) AS DECIMAL(14,2)) END AS default_deal_amount,
       CASE WHEN r_regionkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS default_deal_currency,
       r_regionkey <> 2 AS crm_pipeline_enabled,
       r_regionkey <> 1 AS crm_automation_enabled
FROM {region}
"""

MEMBERS = f"""
SELECT {_org('c_custkey')} AS organization_id,
       'user_' || CAST(c_custkey AS STRING) AS user_id,
       'User ' || c_name AS user_name,
       CASE WHEN c_custkey % 6 = 0 THEN 'removed' WHEN c_custkey % 15 = 4 THEN 'invited' ELSE 'active' END AS status,
       CASE WHEN c_custkey % 5 = 0 THEN FALSE WHEN c_custkey % 7 = 0 THEN CAST(NULL AS BOOLEAN) ELSE TRUE END AS billable,
       CASE WHEN c_custkey % 9 = 0 THEN 'support' ELSE 'customer' END AS member_type,
       {_day('c_custkey % 700')} AS starts_at,
       CASE WHEN c_custkey % 8 = 0 THEN {_day('c_custkey % 500')} END AS ends_at
FROM {{customer}}
"""

CONTACTS = f"""
SELECT 'ct' || CAST(c_custkey AS STRING) AS id,
       {_org('c_custkey')} AS organization_id,
       CASE WHEN c_custkey % 23 = 0 THEN CAST(NULL AS STRING) WHEN c_custkey % 19 = 0 THEN ' '
            ELSE 'First' || CAST(c_custkey % 40 AS STRING) END AS first_name,
       CASE WHEN c_custkey % 23 = 0 THEN '' ELSE 'Last' || CAST(c_custkey % 300 AS STRING) END AS last_name,
       CASE WHEN c_custkey % 23 = 0 THEN '' WHEN c_custkey % 10 = 9 THEN 'Mono'
            ELSE 'First' || CAST(c_custkey % 40 AS STRING) || ' van Last' || CAST(c_custkey % 300 AS STRING) END AS name,
       CASE WHEN c_custkey % 23 = 0 OR c_custkey % 3 = 0 THEN CAST(NULL AS STRING)
            WHEN c_custkey % 13 = 0 THEN 'Person' || CAST(c_custkey % 400 AS STRING) || '@Example.com'
            ELSE 'person' || CAST(c_custkey % 700 AS STRING) || '@example.com' END AS email,
       CASE WHEN c_custkey % 14 = 0 THEN 'invalid' END AS email_validation_response,
       CASE WHEN c_custkey % 23 = 0 THEN CAST(NULL AS STRING)
            WHEN c_custkey % 40 = 1 THEN 'https://www.linkedin.com/in/shared-' || CAST(c_custkey % 8 AS STRING) || '/'
            WHEN c_custkey % 5 = 0 THEN 'HTTP://UK.LinkedIn.com/in/person-' || CAST(c_custkey AS STRING) || '?trk=1'
            WHEN c_custkey % 5 = 1 THEN ' linkedin.com/in/Person-' || CAST(c_custkey AS STRING) || '//'
            WHEN c_custkey % 5 = 2 THEN '//de.linkedin.com/company/acme-' || CAST(c_custkey AS STRING) || '#about'
            WHEN c_custkey % 5 = 3 THEN 'https://example.com/in/person' || CAST(c_custkey AS STRING)
            ELSE 'www.linkedin.com/in/person-' || CAST(c_custkey AS STRING) END AS profile_url,
       CASE c_custkey % 14 WHEN 0 THEN 'PROSPECT' WHEN 1 THEN 'LEAD' WHEN 2 THEN 'APPOINTMENT_REQUESTED'
            WHEN 3 THEN 'APPOINTMENT_SCHEDULED' WHEN 4 THEN 'APPOINTMENT_CANCELLED' WHEN 5 THEN 'PRESENTATION_SCHEDULED'
            WHEN 6 THEN 'CONTRACT_NEGOTIATIONS' WHEN 7 THEN 'AGREEMENT_IN_PRINCIPLE' WHEN 8 THEN 'CLOSED_WON'
            WHEN 9 THEN 'CLOSED_LOST' WHEN 10 THEN 'REENGAGEMENT' WHEN 11 THEN ' prospect ' WHEN 12 THEN ' '
            END AS pipeline_stage,
       CASE WHEN c_custkey % 17 = 0 THEN TRUE WHEN c_custkey % 17 = 1 THEN FALSE END AS do_not_contact,
       CASE WHEN c_custkey % 29 = 0 THEN TRUE END AS stop_drafts,
       CASE WHEN c_custkey % 31 = 0 THEN {_day('c_custkey')} END AS unsubscribed_at,
       CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 37 = 0 THEN CAST(NULL AS STRING)
            ELSE 'thread-' || CAST(c_custkey AS STRING) END AS last_thread_id,
       CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '1999-01-01 00:00:00' + (c_custkey % 900) * INTERVAL '1' DAY END AS last_incoming_email_at,
       CASE WHEN c_custkey % 2 = 0 THEN {_day('c_custkey % 300')} END AS stage_updated_at,
       CASE WHEN c_custkey % 9 = 0 THEN CAST(NULL AS STRING) WHEN c_custkey % 9 = 1 THEN ''
            WHEN c_custkey % 9 = 2 THEN '{{{{"default":"' || n_name || ' area"}}}}'
            WHEN c_custkey % 9 = 3 THEN '{{{{"country":"' || n_name || '"}}}}'
            ELSE '{{{{"city":"City ' || CAST(n_nationkey AS STRING) || '","country":"' || n_name || '"}}}}' END AS location,
       CASE WHEN c_custkey % 8 = 0 THEN '["sales","crm"]' WHEN c_custkey % 8 = 1 THEN '[]' END AS skills,
       CASE WHEN c_custkey % 3 = 0 THEN '["strategy"]' END AS specialities,
       CASE WHEN c_custkey % 4 <> 2 THEN 'c-phone-' || CAST(c_custkey AS STRING) END AS phone,
       CASE WHEN c_custkey % 4 = 1 THEN 'user_' || CAST(c_custkey % 100 AS STRING) END AS assigned_to_user_id,
       CASE c_custkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' END AS processing_status,
       'Title ' || c_mktsegment AS job_title,
       CASE WHEN c_custkey % 3 = 1 THEN '{{{{"score":' || CAST(c_custkey % 100 AS STRING) || ',"reason":"fit"}}}}' END AS lead_score,
       CASE WHEN c_custkey % 3 = 2 THEN '{{{{"summary":"S' || CAST(c_custkey % 10 AS STRING) || '","key_findings":["a","b' || CAST(c_custkey % 5 AS STRING) || '"]}}}}' END AS research,
       CASE WHEN c_custkey % 4 <> 1 THEN '{{{{"openness":' || CAST(c_custkey % 90 AS STRING) || ',"emotionalStability":"0.' || CAST(c_custkey % 9 AS STRING) || '"}}}}' END AS ocean_traits,
       CASE WHEN c_custkey % 5 <> 1 THEN '{{{{"dominance":' || CAST(c_custkey % 80 AS STRING) || '}}}}' END AS disc_traits,
       CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 100 AS DOUBLE) END AS fit_score,
       CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 100 AS DOUBLE) END AS social_score,
       {_day('c_custkey % 700')} AS created_at
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
"""

COMPANIES = f"""
SELECT 'co' || CAST(s_suppkey AS STRING) AS id,
       {_org('s_suppkey')} AS organization_id,
       CASE WHEN s_suppkey % 33 = 7 THEN ' ' WHEN s_suppkey % 21 = 5 THEN 'Acme' ELSE s_name END AS name,
       CASE WHEN s_suppkey % 9 = 0 THEN CAST(NULL AS STRING) WHEN s_suppkey % 9 = 1 THEN ''
            ELSE 'https://www.company' || CAST(s_suppkey % 60 AS STRING) || '.example.com/about' END AS website,
       CASE WHEN s_suppkey % 5 <> 0 THEN 'https://www.linkedin.com/company/c-' || CAST(s_suppkey % 70 AS STRING) || '/' END AS profile_url,
       'Country ' || CAST(s_nationkey AS STRING) AS location,
       CASE s_suppkey % 4 WHEN 0 THEN '1-10' WHEN 1 THEN '11-50' WHEN 2 THEN '51-200' END AS company_size,
       CAST(s_suppkey % 7 * 15 AS INT) AS employee_count,
       CASE WHEN s_suppkey % 3 = 0 THEN CAST(NULL AS STRING) WHEN s_suppkey % 3 = 1 THEN 'Software,Energy'
            ELSE 'Industry ' || CAST(s_nationkey AS STRING) END AS industry_text,
       CASE WHEN s_suppkey % 6 = 0 THEN CAST(NULL AS STRING)
            ELSE '{{{{"score":' || CAST(s_suppkey % 100 AS STRING) || ',"blocked":' || CASE WHEN s_suppkey % 10 = 3 THEN 'true' ELSE 'false' END
                 || CASE s_suppkey % 4 WHEN 0 THEN ',"llm_analysis":{{{{"blocked":' || CASE WHEN s_suppkey % 8 = 0 THEN 'true' ELSE 'false' END || ',"failed_filters":["size' || CAST(s_suppkey % 3 AS STRING) || '","region"]}}}}'
                      WHEN 1 THEN ',"reasoning":{{{{"failed_hard_filters":["country","size' || CAST(s_suppkey % 2 AS STRING) || '"]}}}}'
                      WHEN 2 THEN ',"reasoning":{{{{"hard_filter_failed":"industry"}}}}' ELSE '' END || '}}}}' END AS icp_score,
       CASE WHEN s_suppkey % 10 = 3 OR s_suppkey % 10 = 6 THEN
            '{{{{"final_status":"blocked","steps":[{{{{"step":"early_block_check","data":{{{{"failed_filters":["industry"]}}}}}}}},{{{{"step":"icp_scoring","data":{{{{"failed_filters":["size","country' || CAST(s_suppkey % 4 AS STRING) || '"]}}}}}}}},{{{{"step":"other","data":{{{{"failed_filters":["never"]}}}}}}}}]}}}}' END AS processing_log,
       CASE WHEN s_suppkey % 5 <> 0 THEN '{{{{"industry_fit":' || CAST(s_suppkey % 10 AS STRING) || '.5,"strategic_value":"' || CAST(s_suppkey % 7 AS STRING) || '"}}}}' END AS icp_component_scores,
       CASE WHEN s_suppkey % 3 <> 0 THEN '{{{{"company_overview":{{{{"summary":"S' || CAST(s_suppkey % 6 AS STRING) || '","key_findings":["k1","k' || CAST(s_suppkey % 4 AS STRING) || '"]}}}},"growth_signals":{{{{"summary":"G"}}}}}}}}' END AS research_modules,
       CASE s_suppkey % 8 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'processing' WHEN 2 THEN 'pending' WHEN 3 THEN 'processed'
            WHEN 4 THEN 'approved' WHEN 5 THEN 'declined' WHEN 6 THEN 'failed' END AS processing_status,
       CASE WHEN s_suppkey % 16 = 6 THEN 'timeout' WHEN s_suppkey % 16 = 14 AND s_suppkey % 3 = 0 THEN 'no_website' END AS failure_reason,
       CASE WHEN s_suppkey % 10 IN (3, 6) THEN TRUE WHEN s_suppkey % 10 = 4 THEN FALSE END AS blocked_by_icp,
       CASE WHEN s_suppkey % 20 = 3 THEN TRUE ELSE FALSE END AS manually_unblocked,
       CASE WHEN s_suppkey % 12 = 0 THEN TRUE END AS is_competitor,
       CASE WHEN s_suppkey % 5 <> 1 THEN 's-phone-' || CAST(s_suppkey AS STRING) END AS phone,
       CASE s_suppkey % 3 WHEN 0 THEN '["cloud","erp ' || CAST(s_suppkey % 8 AS STRING) || '"]' WHEN 1 THEN '[]' END AS specialities,
       CASE WHEN s_suppkey % 4 = 0 THEN TRUE WHEN s_suppkey % 4 = 1 THEN FALSE END AS used_for_outreach,
       CAST(s_suppkey % 3 AS INT) AS outreach_count,
       CASE WHEN s_suppkey % 14 = 0 THEN 'user_outsider' WHEN s_suppkey % 2 = 0 THEN 'user_' || CAST(s_suppkey % 100 AS STRING) END AS owner_user_id,
       CASE WHEN s_suppkey % 7 = 0 THEN 'f1,f2' WHEN s_suppkey % 7 = 1 THEN 'f3' END AS file_ids_text,
       {_day('s_suppkey % 900')} AS created_at
FROM {{supplier}}
"""

# a contact links to a company of its own organisation; every sixth has two links, every seventh none
COMPANY_CONTACTS = """
SELECT 'l' || id AS id, organization_id, 'co' || CAST(slot AS STRING) AS company_id, 'ct' || CAST(k AS STRING) AS contact_id,
       CASE WHEN k % 11 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE TIMESTAMP '2024-02-01 00:00:00' + (k % 200) * INTERVAL '1' HOUR END AS created_at
FROM (
  SELECT 'a' || CAST(c_custkey AS STRING) AS id, 'org_' || CAST(c_custkey % 4 AS STRING) AS organization_id, c_custkey AS k,
         (c_custkey % 4) + 4 * (c_custkey % 23) AS slot
  FROM {customer} WHERE c_custkey % 7 <> 0
  UNION ALL
  SELECT 'b' || CAST(c_custkey AS STRING), 'org_' || CAST(c_custkey % 4 AS STRING), c_custkey,
         (c_custkey % 4) + 4 * (c_custkey % 19)
  FROM {customer} WHERE c_custkey % 6 = 0 AND c_custkey % 7 <> 0
) linked
"""

CAMPAIGNS = f"""
SELECT 'camp_' || CAST(n_nationkey AS STRING) AS id,
       {_org('n_nationkey')} AS organization_id,
       'user_' || CAST(n_nationkey AS STRING) AS user_id,
       'Campaign ' || n_name AS name,
       CASE n_nationkey % 6 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'completed'
            WHEN 4 THEN 'active' ELSE 'draft' END AS status,
       CASE WHEN n_nationkey % 5 = 0 THEN '{{{{"launched_at":"2024-01-0' || CAST(1 + n_nationkey % 9 AS STRING) || ' 10:00:00","n":1}}}}'
            WHEN n_nationkey % 5 = 1 THEN '{{{{"completed_steps":["campaign-details","icp-settings","lead-source","curate-leads","review-launch"]}}}}'
            WHEN n_nationkey % 5 = 2 THEN '{{{{"completed_steps":["campaign-details"]}}}}' END AS metadata,
       CASE WHEN n_nationkey % 4 = 1 THEN TRUE WHEN n_nationkey % 4 = 2 THEN FALSE END AS wizard_completed,
       CASE WHEN n_nationkey % 8 = 0 THEN TIMESTAMP '2023-12-24 08:00:00' END AS started_at,
       '[{{{{"id":"co' || CAST(n_nationkey AS STRING) || '","selected":true}}}},{{{{"id":"co' || CAST(n_nationkey + 1 AS STRING)
            || '","selected":false}}}},{{{{"id":"co' || CAST(n_nationkey + 2 AS STRING) || '"}}}}]' AS curated_companies,
       CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey AS INT) END AS emails_sent,
       CASE WHEN n_nationkey % 2 = 0 THEN TRUE END AS autosend_email, n_nationkey % 3 <> 1 AS autosend_linkedin,
       CAST(CASE WHEN n_nationkey % 3 = 0 THEN '0.70' ELSE '0.40' END AS DECIMAL(3,2)) AS autosend_min_confidence,
       CASE WHEN n_nationkey % 4 = 0 THEN 'ooo,question' ELSE 'ooo' END AS autosend_intents_text,
       {_day('n_nationkey * 5')} AS created_at
FROM {{nation}}
"""

# a company belongs to one or two campaigns of its own organisation
CAMPAIGN_COMPANIES = """
SELECT id, organization_id, campaign_id, company_id, status, blocked_by_icp, icp_profile_id, created_at FROM (
  SELECT 'cc' || CAST(s_suppkey AS STRING) AS id, 'org_' || CAST(s_suppkey % 4 AS STRING) AS organization_id,
         'camp_' || CAST((s_suppkey % 4) + 4 * (s_suppkey % 6) AS STRING) AS campaign_id, 'co' || CAST(s_suppkey AS STRING) AS company_id,
         CASE WHEN s_suppkey % 3 = 0 THEN 'pending' WHEN s_suppkey % 3 = 1 THEN 'approved' END AS status,
         s_suppkey % 5 = 0 AS blocked_by_icp, 'icp_' || CAST(s_suppkey % 3 AS STRING) AS icp_profile_id,
         TIMESTAMP '2024-01-10 00:00:00' + s_suppkey * INTERVAL '1' MINUTE AS created_at
  FROM {supplier}
  UNION ALL
  SELECT 'cd' || CAST(s_suppkey AS STRING), 'org_' || CAST(s_suppkey % 4 AS STRING),
         'camp_' || CAST((s_suppkey % 4) + 4 * ((s_suppkey + 1) % 6) AS STRING), 'co' || CAST(s_suppkey AS STRING),
         'pending', FALSE, 'icp_1', TIMESTAMP '2024-01-11 00:00:00' + s_suppkey * INTERVAL '1' MINUTE
  FROM {supplier} WHERE s_suppkey % 4 = 1
) linked
"""

# ---------------------------------------------------------------- usage ledger

USAGE = f"""
SELECT 'u' || CAST(event_id AS STRING) AS id,
       {_org('user_id')} AS organization_id,
       's' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id,
       provider, model_name,
       CAST(1 + event_id % 3 AS INT) AS api_calls,
       CAST(in_tok AS INT) AS input_tokens, CAST(out_tok AS INT) AS output_tokens,
       CAST(CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 29 = 0 THEN NULL ELSE in_tok + out_tok END AS INT) AS total_tokens,
       CASE WHEN event_id % 4 = 0 THEN CAST(NULL AS STRING) ELSE 'run_' || CAST(event_id % 500 AS STRING) END AS run_id,
       CASE event_id % 4 WHEN 0 THEN 'campaign' WHEN 1 THEN 'chat' WHEN 2 THEN 'research' END AS usage_context,
       CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 31 = 0 THEN ''
            ELSE 'camp_' || CAST((user_id % 4) + 4 * (event_id % 6) AS STRING) END AS campaign_id,
       CASE WHEN event_id % 11 = 0 THEN CAST(NULL AS STRING) ELSE 'user_' || CAST(user_id AS STRING) END AS user_id,
       CASE WHEN event_id % 3 = 0 THEN 'inv_' || CAST(event_id % 40 AS STRING) END AS invoice_id,
       CASE WHEN event_id % 43 = 0 THEN CAST(NULL AS DECIMAL(12,6)) ELSE CAST('0.' || lpad(CAST(event_id % 99991 AS STRING), 6, '0') AS DECIMAL(12,6)) END AS list_cost,
       CASE WHEN event_id % 13 = 0 THEN CAST(0 AS DECIMAL(12,6)) ELSE CAST(CAST(event_id % 17 AS STRING) || '.' || lpad(CAST(event_id % 9973 AS STRING), 6, '0') AS DECIMAL(12,6)) END AS billed_cost,
       CASE WHEN event_id % 97 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 89 = 0 THEN '[1,2]' WHEN event_id % 83 = 0 THEN '{{{{broken'
            WHEN event_id % 50 = 1 THEN chr(34) || replace(meta, chr(34), chr(92) || chr(34)) || chr(34)
            ELSE meta END AS metadata,
       CASE WHEN event_id % 101 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE CAST(ts AS TIMESTAMP) END AS created_at
FROM (
  SELECT *, CASE provider WHEN 'openai' THEN 'gpt-4.1-mini' WHEN 'gemini' THEN 'gemini-2.5-flash' WHEN 'hunter' THEN 'hunter-email'
              WHEN 'airscale' THEN CASE WHEN event_id % 4 < 2 THEN 'airscale-phone-finder' ELSE 'airscale-email_finder' END
              WHEN 'ai_ark' THEN CASE event_id % 5 WHEN 0 THEN 'ai-ark-similar_companies' WHEN 1 THEN 'ai-ark-person_profile' WHEN 2 THEN 'ai-ark-people_search' END
              WHEN 'b2b_enrichment' THEN CASE event_id % 6 WHEN 0 THEN 'b2b-email_verifier' WHEN 1 THEN 'b2b-email_finder' WHEN 2 THEN 'b2b-people_search-v2'
                   WHEN 3 THEN 'b2b-similar_companies' WHEN 4 THEN 'b2b-company_profile' ELSE 'b2b-enrich' END
              WHEN 'exa' THEN 'exa-search' WHEN 'xai' THEN 'grok-4' WHEN 'icypeas' THEN 'icypeas-email' WHEN 'apollo' THEN 'apollo-email_finder'
              WHEN 'togetherai' THEN 'deepseek-v3' END AS model_name,
         CASE WHEN provider IN ('openai', 'gemini', 'xai', 'togetherai', 'new_vendor') THEN CAST(floor(value * 10) AS BIGINT) ELSE 0 END AS in_tok,
         CASE WHEN provider IN ('openai', 'gemini', 'xai', 'togetherai', 'new_vendor') THEN CAST(floor(value * 3) AS BIGINT) ELSE 0 END AS out_tok,
         '{{{{"service":"' || CASE event_id % 6 WHEN 0 THEN 'company_research' WHEN 1 THEN 'email_generation_service' WHEN 2 THEN 'email_reply_processor_service'
                                WHEN 3 THEN 'contact_finder' ELSE 'chat' END
           || '","operation":"' || event_type || '","action":"' || CASE event_id % 8 WHEN 0 THEN 'phone_finder' WHEN 1 THEN 'people_search' WHEN 2 THEN ' Similar_Companies '
                                WHEN 3 THEN 'person_profile' WHEN 4 THEN 'email_finder' WHEN 5 THEN 'company_profile' ELSE '' END || '"'
           || CASE event_id % 7 WHEN 0 THEN ',"emails_found":' || CAST(event_id % 5 AS STRING) WHEN 1 THEN ',"found_emails":[],"emails":["x","y"]'
                                WHEN 2 THEN ',"people_found":{{{{"count":' || CAST(event_id % 4 AS STRING) || '}}}}' WHEN 3 THEN ',"companies_found":" 3 "'
                                WHEN 4 THEN ',"results":[1,2,3]' WHEN 5 THEN ',"phone":"+49 30"' ELSE ',"email":false' END
           || CASE event_id % 5 WHEN 0 THEN ',"billable_units":2' WHEN 1 THEN ',"billable_units":"1.5"' WHEN 2 THEN ',"success":true' WHEN 3 THEN ',"success":"yes"' ELSE '' END
           || CASE event_id % 9 WHEN 0 THEN ',"grounding_queries":2' WHEN 1 THEN ',"research_flow":"ultra_lean"' WHEN 2 THEN ',"effective_provider":"both"'
                                WHEN 3 THEN ',"provider_name":"deep-seek_chat","effective_provider":"both"' WHEN 4 THEN ',"research_flow":"advanced_research"'
                                WHEN 5 THEN ',"research_flow":"compact","provider":"gemini"' ELSE '' END
           || CASE WHEN event_id % 10 = 0 THEN ',"company_id":"co' || CAST(event_id % 100 AS STRING) || '","research_run_id":"rr' || CAST(event_id % 30 AS STRING) || '"' ELSE '' END
           || '}}}}' AS meta
  FROM (
    SELECT *, CASE event_id % 12 WHEN 0 THEN 'openai' WHEN 1 THEN 'gemini' WHEN 2 THEN 'hunter' WHEN 3 THEN 'airscale' WHEN 4 THEN 'ai_ark'
                WHEN 5 THEN 'b2b_enrichment' WHEN 6 THEN 'exa' WHEN 7 THEN 'xai' WHEN 8 THEN 'icypeas' WHEN 9 THEN 'apollo' WHEN 10 THEN 'togetherai'
                ELSE 'new_vendor' END AS provider
    FROM {{events}}
  ) with_provider
) with_metadata
"""

AGENT_RUNS = f"""
SELECT 'run_' || CAST(o_orderkey AS STRING) AS run_id, {_org('o_custkey')} AS organization_id,
       's' || CAST(o_custkey AS STRING) AS session_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'gpt-4.1-mini' WHEN 1 THEN 'o3' END AS model_name,
       CAST(o_orderkey % 900 AS INT) AS total_input_tokens, CAST(o_orderkey % 300 AS INT) AS total_output_tokens,
       CAST(o_orderkey % 900 + o_orderkey % 300 AS INT) AS total_tokens, CAST(o_orderkey % 60 AS BIGINT) AS total_processing_time,
       'agent_' || CAST(o_orderkey % 5 AS STRING) AS agent_id, o_orderpriority AS content,
       CASE WHEN o_orderkey % 4 = 0 THEN 'chat' END AS event, '{{{{"k":1}}}}' AS metrics_raw,
       CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 1440) * INTERVAL '1' MINUTE AS created_at
FROM {{orders}}
"""

TOKEN_USAGE = f"""
SELECT event_id AS id, {_org('user_id')} AS organization_id, 's' || CAST(user_id AS STRING) AS session_id,
       CASE event_id % 3 WHEN 0 THEN 'agent_run' WHEN 1 THEN 'openai' ELSE 'gemini' END AS provider,
       CASE WHEN event_id % 4 <> 0 THEN 'model-' || CAST(event_id % 4 AS STRING) END AS model_name,
       CAST(1 + event_id % 5 AS INT) AS total_calls, CAST(floor(value * 10) AS INT) AS total_input_tokens,
       CAST(floor(value) AS INT) AS total_output_tokens, CAST(floor(value * 10) + floor(value) AS INT) AS total_tokens,
       CAST(ts AS TIMESTAMP) AS tracking_start, CAST(ts AS TIMESTAMP) + (event_id % 90) * INTERVAL '1' MINUTE AS tracking_end
FROM {{events}}
"""

# ---------------------------------------------------------------- billing

BILLING_INVOICES = f"""
SELECT 'inv' || CAST(o_orderkey AS STRING) AS id, {_org('o_custkey')} AS organization_id,
       CAST(o_totalprice AS DECIMAL(12,2)) AS total,
       CASE o_orderkey % 6 WHEN 0 THEN 'paid' WHEN 1 THEN 'open' WHEN 2 THEN 'sent' WHEN 3 THEN 'draft' WHEN 4 THEN 'failed' ELSE 'void' END AS status,
       CAST(o_orderdate AS TIMESTAMP) AS period_start, CAST(o_orderdate AS TIMESTAMP) + INTERVAL '7' DAY AS period_end,
       CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '8' DAY END AS created_at
FROM {{orders}}
"""

BILLING_CUSTOMERS = """
SELECT 'org_' || CAST(r_regionkey * 2 AS STRING) AS organization_id, CASE WHEN r_regionkey % 2 = 0 THEN 'active' ELSE 'past_due' END AS status,
       r_regionkey <> 1 AS auto_charge_enabled, 'billing' || CAST(r_regionkey AS STRING) || '@example.com' AS billing_email,
       'visa' AS card_brand, '42' || CAST(10 + r_regionkey AS STRING) AS card_last4, CAST(500 AS DECIMAL(10,2)) AS monthly_spend_limit
FROM {region}
"""

DISCOUNT_CODES = """
SELECT 'CODE' || CAST(n_nationkey AS STRING) AS code, CASE WHEN n_nationkey % 2 = 0 THEN 'percentage' ELSE 'fixed_amount' END AS discount_type,
       CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey * 20 AS INT) END AS max_uses,
       CASE WHEN n_nationkey % 4 = 0 THEN TIMESTAMP '1998-01-01 00:00:00' + n_nationkey * INTERVAL '30' DAY END AS expires_at
FROM {nation}
"""

DISCOUNT_REDEMPTIONS = f"""
SELECT 'r' || CAST(o_orderkey AS STRING) AS id, 'CODE' || CAST(o_custkey % 20 AS STRING) AS code, {_org('o_custkey')} AS organization_id,
       CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS DECIMAL(12,2)) AS amount_discounted, CAST(o_orderdate AS TIMESTAMP) AS redeemed_at
FROM {{orders}}
"""

# ---------------------------------------------------------------- outreach facts

TASKS = f"""
SELECT 'tk' || CAST(o_orderkey AS STRING) AS id, {_org('o_custkey')} AS organization_id,
       CASE WHEN o_orderkey % 41 = 0 THEN CAST(NULL AS STRING) ELSE 'ct' || CAST(o_custkey AS STRING) END AS contact_id,
       CASE WHEN o_orderkey % 9 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 47 = 0 THEN 'camp_missing'
            ELSE 'camp_' || CAST((o_custkey % 4) + 4 * (o_custkey % 6) AS STRING) END AS campaign_id,
       CASE WHEN o_orderkey % 5 <> 0 THEN 'co' || CAST((o_custkey % 4) + 4 * (o_custkey % 23) AS STRING) END AS company_id,
       CASE o_orderkey % 12 WHEN 0 THEN 'meeting' WHEN 1 THEN 'company_verification' WHEN 2 THEN 'email_generation_processing' WHEN 3 THEN 'review_reply'
            WHEN 4 THEN CAST(NULL AS STRING) WHEN 5 THEN 'connect' WHEN 8 THEN CASE WHEN o_orderkey % 24 = 8 THEN 'manual_outreach' ELSE 'review_draft' END ELSE 'review_draft' END AS task_type,
       CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'scheduled' ELSE 'in_review' END
            ELSE CASE o_orderkey % 7 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'rejected' WHEN 2 THEN 'failed' WHEN 3 THEN 'pending' ELSE 'completed' END END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN 'sent_success' WHEN o_orderkey % 3 = 1 THEN 'sent_failed' END AS send_status,
       CASE WHEN o_orderkey % 4 = 3 THEN CAST(NULL AS TIMESTAMP) ELSE CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL '1' HOUR END AS sent_at,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 20) * INTERVAL '1' DAY END AS due_date,
       CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 3) * INTERVAL '1' DAY END AS completed_at,
       CASE WHEN o_orderkey % 53 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 5) * INTERVAL '1' MINUTE END AS created_at,
       CASE WHEN o_orderkey % 5 = 0 THEN 'user_' || CAST(o_custkey % 100 AS STRING) END AS created_by_user_id,
       CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 8 = 1 THEN CAST(NULL AS STRING) ELSE 'msg-' || CAST(o_orderkey - o_orderkey % 2 AS STRING) END AS email_id,
       CASE WHEN o_orderkey % 5 = 1 THEN '' WHEN o_orderkey % 5 = 2 THEN CAST(NULL AS STRING) ELSE 'thread-' || CAST(o_custkey AS STRING) END AS thread_id,
       CASE WHEN o_orderkey % 11 = 3 THEN 'linkedin' WHEN o_orderkey % 11 = 4 THEN 'manual' ELSE 'email' END AS channel,
       CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 10 = 1 THEN CAST(NULL AS STRING) ELSE 'Body ' || o_orderpriority END AS body,
       CASE o_orderkey % 8 WHEN 0 THEN '{{{{"email_type":"initial"}}}}' WHEN 1 THEN '{{{{"emailType":"Reply "}}}}' WHEN 2 THEN '{{{{"type":"timeslots"}}}}'
            WHEN 3 THEN '{{{{"email_type":"initial","open_tracking":{{{{"first_opened_at":"1997-03-04 05:06:07"}}}}}}}}'
            WHEN 4 THEN '{{{{"email_type":"","open_tracking":{{{{"first_opened_at":"","last_opened_at":"1998-05-06"}}}}}}}}'
            WHEN 5 THEN '{{{{"email_type":"positive_follow_up_1","open_tracking":{{{{"first_opened_at":"soon"}}}}}}}}'
            WHEN 6 THEN '{{{{"copy_claimed_at":"2002-01-0' || CAST(1 + o_orderkey % 9 AS STRING) || ' 10:00:00","n":3}}}}' WHEN 7 THEN '{{{{"channel":"linkedin"}}}}' END AS metadata
FROM {{orders}}
"""

CAMPAIGN_EMAILS = f"""
SELECT 'em' || CAST(o_orderkey AS STRING) AS id, {_org('o_custkey')} AS organization_id,
       CASE WHEN o_orderkey % 59 = 0 THEN CAST(NULL AS STRING) ELSE 'camp_' || CAST((o_custkey % 4) + 4 * (o_custkey % 6) AS STRING) END AS campaign_id,
       'ct' || CAST(o_custkey AS STRING) AS contact_id,
       CASE o_orderkey % 9 WHEN 0 THEN 'draft' WHEN 1 THEN 'sent' WHEN 2 THEN 'delivered' WHEN 3 THEN 'opened' WHEN 4 THEN 'clicked' WHEN 5 THEN 'replied'
            WHEN 6 THEN 'bounced' WHEN 7 THEN 'failed' ELSE 'scheduled' END AS status,
       CASE WHEN o_orderkey % 6 = 0 THEN 'msg-' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 6 = 1 THEN '' END AS message_id,
       CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 7 = 1 THEN '' ELSE 'thread-' || CAST(o_custkey AS STRING) END AS thread_id,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 24) * INTERVAL '1' HOUR END AS sent_at,
       CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '2' DAY END AS opened_at,
       CASE WHEN o_orderkey % 8 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '3' DAY END AS replied_at,
       CASE WHEN o_orderkey % 16 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '60' HOUR END AS reply_received_at,
       CASE WHEN o_orderkey % 19 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' HOUR END AS bounced_at,
       CASE o_orderkey % 10 WHEN 0 THEN '{{{{"email_type":"reply"}}}}' WHEN 1 THEN '{{{{"email_type":"initial"}}}}' WHEN 2 THEN '{{{{"replyType":" General_Response "}}}}'
            WHEN 3 THEN '{{{{"email_type":null,"type":"inquiry_response"}}}}' END AS metadata,
       CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM {{orders}}
"""

# the reply stream delivers every tenth event twice under one dedup key
EMAIL_REPLY_EVENTS = f"""
SELECT {_org('user_id')} AS organization_id, 'reply:' || CAST(CASE WHEN event_id % 10 = 1 THEN event_id - 1 ELSE event_id END AS STRING) AS dedup_key,
       'msg-' || CAST(event_id AS STRING) AS email_id, 'acct_' || CAST(user_id % 9 AS STRING) AS account_id,
       CASE WHEN event_id % 6 = 0 THEN '' WHEN event_id % 6 = 1 THEN CAST(NULL AS STRING) ELSE 'thread-' || CAST(user_id AS STRING) END AS thread_id,
       CASE WHEN event_id % 4 <> 0 THEN 'ct' || CAST(user_id AS STRING) END AS contact_id,
       CASE WHEN event_id % 7 = 0 THEN CAST(NULL AS STRING) ELSE 'camp_' || CAST((user_id % 4) + 4 * (user_id % 6) AS STRING) END AS campaign_id,
       CAST(ts AS TIMESTAMP) AS received_at,
       CASE event_id % 3 WHEN 0 THEN 'interested' WHEN 1 THEN 'question' ELSE 'other' END AS classification,
       CASE WHEN event_id % 2 = 0 THEN 'high' ELSE 'low' END AS relevance
FROM {{events}}
"""

SHORT_URLS = f"""
SELECT 'url' || CAST(page_id AS STRING) AS id, {_org('page_id')} AS organization_id, url AS target_url,
       CASE WHEN page_id % 3 = 0 THEN {_day('page_id % 60', 'DAY')} END AS expires_at, page_id % 5 <> 0 AS is_active
FROM {{pages}}
"""

DOCUMENT_ACCESS_EVENTS = """
SELECT 'a' || CAST(event_id AS STRING) AS id, 'url' || CAST(event_id % 200 AS STRING) AS short_url_id,
       CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'view_end' ELSE event_type END AS event_type,
       CAST(floor(value) AS INT) AS duration_seconds, CAST(ts AS TIMESTAMP) AS accessed_at
FROM {events}
"""

LINKEDIN_ACTION_LOG = f"""
SELECT 'la' || CAST(event_id AS STRING) AS id, {_org('user_id')} AS organization_id, 'acct_' || CAST(user_id % 9 AS STRING) AS account_id,
       CASE event_type WHEN 'view' THEN 'profile_view' WHEN 'click' THEN 'connect' WHEN 'signup' THEN 'message' ELSE 'invite' END AS action_type,
       CASE WHEN event_id % 9 = 0 THEN FALSE WHEN event_id % 31 = 0 THEN CAST(NULL AS BOOLEAN) ELSE TRUE END AS success,
       CASE WHEN event_id % 4 = 0 THEN 'camp_' || CAST((user_id % 4) + 4 * (user_id % 6) AS STRING) END AS campaign_id,
       CASE WHEN event_id % 3 <> 0 THEN '{{{{"task_id":"tk' || CAST(event_id AS STRING) || '"}}}}' END AS payload,
       CAST(ts AS TIMESTAMP) AS created_at
FROM {{events}}
"""

CAMPAIGN_CONTACTS = f"""
SELECT 'jr' || CAST(c_custkey AS STRING) AS id, {_org('c_custkey')} AS organization_id,
       'camp_' || CAST((c_custkey % 4) + 4 * (c_custkey % 6) AS STRING) AS campaign_id, 'ct' || CAST(c_custkey AS STRING) AS contact_id,
       CASE WHEN c_custkey % 5 = 0 THEN 'removed' ELSE 'active' END AS status, 'manual' AS source_type,
       CASE c_custkey % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'queued_invite' WHEN 2 THEN 'invited' WHEN 3 THEN 'accepted' WHEN 4 THEN 'replied' WHEN 5 THEN 'declined'
            WHEN 6 THEN 'completed' WHEN 7 THEN 'messaged' ELSE 'cancelled' END AS journey_state,
       CASE WHEN c_custkey % 4 <> 3 THEN {_day('c_custkey % 900')} END AS next_action_at, {_day('c_custkey % 800')} AS added_at
FROM {{customer}} WHERE c_custkey % 8 <> 0
"""

SEQUENCE_ACTIONS = f"""
SELECT 'sa' || CAST(o_orderkey AS STRING) AS id, {_org('o_custkey')} AS organization_id, 'jr' || CAST(o_custkey AS STRING) AS campaign_contact_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'email' ELSE 'linkedin' END AS channel, 'step_' || CAST(o_orderkey % 3 AS STRING) AS action_type,
       CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'claimed' WHEN 2 THEN 'done' ELSE 'pending' END AS status,
       CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS scheduled_at,
       CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '100' DAY END AS retry_at,
       CASE WHEN o_orderkey % 8 = 1 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY END AS lease_expires_at,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 4 AS INT) END AS attempts,
       CASE WHEN o_orderkey % 3 <> 2 THEN 'tk' || CAST(o_orderkey AS STRING) END AS review_task_id
FROM {{orders}}
"""

CAMPAIGN_ACTIVITIES = f"""
SELECT 'ac' || CAST(event_id AS STRING) AS id, {_org('user_id')} AS organization_id, 'camp_' || CAST((user_id % 4) + 4 * (user_id % 6) AS STRING) AS campaign_id,
       CASE event_type WHEN 'purchase' THEN 'meeting_booked' ELSE event_type END AS activity_type, CAST(ts AS TIMESTAMP) AS created_at
FROM {{events}}
"""

EMAIL_STATUS_CHANGES = """
SELECT id, organization_id, campaign_id, contact_id, status, message_id, thread_id, sent_at, opened_at, replied_at, bounced_at,
       CASE WHEN opened_at IS NULL THEN sent_at END AS delivered_at,
       CASE WHEN message_id IS NULL THEN 'Hello ' || contact_id END AS subject,
       CASE WHEN thread_id IS NULL THEN CAST(NULL AS STRING) WHEN bounced_at IS NULL THEN 'scheduled' ELSE 'bounced' END AS old_status
FROM {campaign_emails}
"""

# JSON values of all types under plain, dotted and nested keys
TYPED_DOCUMENTS = """
SELECT 'td' || CAST(p_partkey AS STRING) AS id,
       CASE p_partkey % 6 WHEN 0 THEN '{{"k":1,"a.b":"x","n":{{"z":1}}}}' WHEN 1 THEN '{{"k":"1","a":{{"b":"x"}},"n":{{"z":"1","y":1}}}}'
            WHEN 2 THEN '{{"k":1.0,"n":{{"z":1,"y":2}},"tags":["crm","sales"]}}' WHEN 3 THEN '{{"k":null,"tags":"crm"}}'
            WHEN 4 THEN '{{"k":true,"a.b":"y","tags":[["crm"],"x"],"n":[1]}}' ELSE '{{"tags":["sales' || CAST(p_partkey % 3 AS STRING) || '"],"n":{{}}}}' END AS doc
FROM {part}
"""

# companies named by a list: by URL, by name in another case, by domain, or unknown
OUTREACH_CANDIDATES = f"""
SELECT 'cand' || CAST(p_partkey AS STRING) AS candidate_id, {_org('p_partkey')} AS organization_id,
       CASE p_partkey % 5 WHEN 0 THEN 'https://www.linkedin.com/company/c-' || CAST(p_partkey % 90 AS STRING) || '/' WHEN 1 THEN '' END AS profile_url,
       CASE p_partkey % 3 WHEN 0 THEN 'SUPPLIER#' || lpad(CAST(p_partkey % 150 AS STRING), 9, '0') WHEN 1 THEN 'acme' END AS name,
       CASE WHEN p_partkey % 4 <> 3 THEN 'company' || CAST(p_partkey % 80 AS STRING) || '.example.com' END AS domain
FROM {{part}}
"""

SUPPRESSIONS = f"""
SELECT CASE WHEN c_custkey % 5 > 0 THEN 'nobody' WHEN c_custkey % 2 = 0 THEN 'Person' ELSE 'person' END || CAST(c_custkey % 700 AS STRING) || '@example.com' AS email,
       CASE WHEN c_custkey % 9 <> 0 THEN {_org('c_custkey')} END AS organization_id,
       CASE WHEN c_custkey % 2 = 0 THEN 'onboarding_lifecycle' ELSE 'marketing' END AS scope
FROM {{customer}}
"""

REPLY_DRAFTS = f"""
SELECT 'rd' || CAST(event_id AS STRING) AS id, {_org('user_id')} AS organization_id, 'camp_' || CAST((user_id % 4) + 4 * (user_id % 7) AS STRING) AS campaign_id,
       CASE WHEN event_id % 3 = 0 THEN 'linkedin' ELSE 'email' END AS channel,
       CASE event_id % 4 WHEN 0 THEN 'ooo' WHEN 1 THEN 'question' WHEN 2 THEN 'objection' END AS intent,
       CASE WHEN event_id % 11 <> 0 THEN CAST('0.' || lpad(CAST(event_id % 100 AS STRING), 2, '0') AS DECIMAL(3,2)) END AS confidence
FROM {{events}}
"""

RAW_UPDATES = f"""
SELECT 'raw' || CAST(p_partkey AS STRING) AS record_id, {_org('p_partkey')} AS organization_id,
       CASE WHEN p_partkey % 2 = 0 THEN 'co' || CAST(p_partkey % 100 + CASE WHEN p_partkey % 14 = 0 THEN 1 ELSE 0 END AS STRING) END AS company_id,
       CASE WHEN p_partkey % 3 = 0 THEN 'ct' || CAST(p_partkey % 100 AS STRING) END AS person_id
FROM {{part}}
"""

CRM_RAW_RECORDS = f"""
SELECT 'raw' || CAST(p_partkey AS STRING) AS id, {_org('p_partkey')} AS organization_id, p_name AS raw_name,
       CASE WHEN p_partkey % 7 = 0 THEN 'co7' END AS extracted_company_id, CAST(NULL AS STRING) AS extracted_person_id
FROM {{part}}
"""

CRM_LIST_MEMBERS = f"""
SELECT {_org('o_custkey')} AS organization_id, 'list' || CAST(o_custkey % 10 AS STRING) AS list_id,
       CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 50 = 1 THEN 'co' || CAST(o_custkey % 100 AS STRING) END AS company_id,
       CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 40 <> 2 THEN 'ct' || CAST(o_custkey AS STRING) END AS contact_id, CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM {{orders}}
"""

# older drafts: some are tasks already, some name lost contacts, companies or campaigns
EMAIL_COPY_DRAFTS = f"""
SELECT 'tk' || CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 10000000 + o_orderkey END AS STRING) AS id, {_org('o_custkey')} AS organization_id,
       'ct' || CAST(CASE WHEN o_orderkey % 13 = 0 THEN 900000000 ELSE o_custkey END AS STRING) AS contact_id,
       CASE WHEN o_orderkey % 17 = 0 THEN 'co_missing' WHEN o_orderkey % 3 = 0 THEN 'co' || CAST(o_custkey % 4 AS STRING) END AS company_id,
       CASE WHEN o_orderkey % 19 = 0 THEN 'camp_missing' WHEN o_orderkey % 4 <> 1 THEN 'camp_' || CAST(o_custkey % 4 AS STRING) END AS campaign_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'sent' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' WHEN 3 THEN 'in_review' WHEN 4 THEN 'odd' ELSE 'pending' END AS status,
       CASE WHEN o_orderkey % 5 <> 0 THEN 'Copy ' || CAST(o_orderkey AS STRING) END AS body, 'Subject ' || o_orderpriority AS subject, CAST(NULL AS STRING) AS thread_id,
       CASE WHEN o_orderkey % 6 = 0 THEN 'sent_success' END AS send_status, CAST(NULL AS TIMESTAMP) AS sent_at, CAST(NULL AS STRING) AS metadata, CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM {{orders}}
"""

# ---------------------------------------------------------------- deals

DEALS = f"""
SELECT id, organization_id, company_id, primary_contact_id, stage_contact_id, source_campaign_id, owner_user_id, name, stage, amount, currency, creation_source,
       nurture_enabled, snoozed_until, stage_updated_at, last_activity_at, CASE WHEN stage IN ('WON', 'LOST') THEN stage_updated_at END AS closed_at, created_at
FROM (
  SELECT 'dl' || CAST(s_suppkey AS STRING) AS id, {_org('s_suppkey')} AS organization_id, 'co' || CAST(s_suppkey AS STRING) AS company_id,
         'ct' || CAST(s_suppkey AS STRING) AS primary_contact_id, CASE WHEN s_suppkey % 3 = 0 THEN 'ct' || CAST(s_suppkey AS STRING) END AS stage_contact_id,
         CASE WHEN s_suppkey % 5 = 0 THEN 'camp_' || CAST(s_suppkey % 4 AS STRING) END AS source_campaign_id,
         CASE WHEN s_suppkey % 3 = 1 THEN 'user_' || CAST(s_suppkey % 100 AS STRING) END AS owner_user_id, 'Deal ' || s_name AS name,
         CASE s_suppkey % 8 WHEN 0 THEN 'LEAD' WHEN 1 THEN 'MEETING_REQUESTED' WHEN 2 THEN 'MEETING_BOOKED' WHEN 3 THEN 'PRESENTATION' WHEN 4 THEN 'NEGOTIATION'
              WHEN 5 THEN 'AGREEMENT' WHEN 6 THEN 'WON' ELSE 'LOST' END AS stage,
         CAST(1000 + s_suppkey AS DECIMAL(14,2)) AS amount, CASE WHEN s_suppkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
         CASE WHEN s_suppkey % 4 = 2 THEN 'manual' ELSE 'automatic' END AS creation_source, s_suppkey % 7 <> 0 AS nurture_enabled,
         CASE WHEN s_suppkey % 10 = 0 THEN {_day('s_suppkey % 90', 'DAY')} END AS snoozed_until, {_day('s_suppkey % 60', 'DAY')} AS stage_updated_at,
         {_day('s_suppkey % 50', 'DAY')} AS last_activity_at, {_day('s_suppkey % 40')} AS created_at
  FROM {{supplier}} WHERE s_suppkey % 9 <> 4
  UNION ALL
  SELECT 'dm' || CAST(s_suppkey AS STRING), {_org('s_suppkey')}, 'co' || CAST(s_suppkey AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
         'Second ' || s_name, CASE WHEN s_suppkey % 24 = 1 THEN 'LEAD' ELSE 'LOST' END, CAST(NULL AS DECIMAL(14,2)), 'USD', 'manual', TRUE, CAST(NULL AS TIMESTAMP),
         {_day('s_suppkey % 30', 'DAY')}, {_day('s_suppkey % 20', 'DAY')}, {_day('s_suppkey % 10')}
  FROM {{supplier}} WHERE s_suppkey % 6 = 1
) all_deals
"""

# the same deals one edit later; some are new, some gone
DEALS_AFTER = """
SELECT id, organization_id, company_id, primary_contact_id, stage_contact_id, source_campaign_id,
       CASE WHEN k % 3 = 0 THEN 'user_' || CAST(k % 100 AS STRING) WHEN k % 12 = 1 THEN CAST(NULL AS STRING) ELSE owner_user_id END AS owner_user_id, name,
       CASE WHEN k % 5 = 1 AND closed_at IS NULL THEN 'WON' WHEN k % 5 = 2 AND closed_at IS NULL THEN 'AGREEMENT' WHEN k % 5 = 3 THEN 'LEAD' ELSE stage END AS stage,
       CASE WHEN k % 4 = 1 THEN amount + 5 WHEN k % 16 = 2 THEN CAST(NULL AS DECIMAL(14,2)) ELSE amount END AS amount, CASE WHEN k % 10 = 7 THEN 'GBP' ELSE currency END AS currency, creation_source,
       CASE WHEN k % 11 = 3 THEN NOT nurture_enabled ELSE nurture_enabled END AS nurture_enabled, CASE WHEN k % 10 = 0 THEN CAST(NULL AS TIMESTAMP) WHEN k % 13 = 5 THEN TIMESTAMP '2024-08-01 00:00:00' ELSE snoozed_until END AS snoozed_until,
       stage_updated_at, last_activity_at,
       CASE WHEN k % 5 = 1 AND closed_at IS NULL THEN TIMESTAMP '2024-05-01 00:00:00' WHEN k % 5 = 3 THEN CAST(NULL AS TIMESTAMP) ELSE closed_at END AS closed_at, created_at
FROM (SELECT *, CAST(substr(id, 3) AS BIGINT) AS k FROM {deals} WHERE id NOT LIKE 'dm%') numbered WHERE k % 17 <> 3
UNION ALL
SELECT 'dn' || CAST(s_suppkey AS STRING), 'org_' || CAST(s_suppkey % 4 AS STRING), 'co' || CAST(s_suppkey AS STRING), 'ct' || CAST(s_suppkey AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
       CASE WHEN s_suppkey % 2 = 0 THEN 'user_' || CAST(s_suppkey % 100 AS STRING) END, 'New ' || s_name, 'MEETING_BOOKED', CAST(10 AS DECIMAL(14,2)), 'USD', 'automatic', TRUE, CAST(NULL AS TIMESTAMP),
       TIMESTAMP '2024-04-01 00:00:00', TIMESTAMP '2024-04-01 00:00:00', CAST(NULL AS TIMESTAMP), TIMESTAMP '2024-04-01 00:00:00'
FROM {supplier} WHERE s_suppkey % 9 = 4
"""

DEAL_TASKS = f"""
SELECT 'dt' || CAST(o_orderkey AS STRING) AS id, {_org('o_custkey')} AS organization_id, CASE WHEN o_orderkey % 6 <> 0 THEN 'dl' || CAST((o_custkey % 4) + 4 * (o_orderkey % 20) AS STRING) END AS deal_id,
       'ct' || CAST(o_custkey AS STRING) AS contact_id,
       CASE WHEN o_orderkey % 250 = 0 THEN 'nurture_reminder' WHEN o_orderkey % 250 = 1 THEN 'linkedin_connect' WHEN o_orderkey % 5 = 2 THEN 'manual_outreach' ELSE 'meeting' END AS task_type,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'in_progress' ELSE 'cancelled' END END AS status,
       CASE WHEN o_orderkey % 4 = 0 THEN '{{{{"channel":"email","n":1}}}}' END AS metadata, 'user_' || CAST(o_custkey AS STRING) AS assigned_to_user_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'user_' || CAST(o_custkey AS STRING) WHEN o_orderkey % 3 = 1 THEN 'api' END AS created_by_user_id,
       CASE WHEN o_orderkey % 3 = 1 THEN 'user_' || CAST(o_custkey AS STRING) END AS completed_by_user_id,
       CAST(o_orderdate AS TIMESTAMP) AS due_date, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '400' DAY END AS completed_at, CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM {{orders}}
"""

DEAL_ACTIVITIES = f"""
SELECT 'da' || CAST(event_id AS STRING) AS id, 'dl' || CAST((user_id % 4) + 4 * (event_id % 22) AS STRING) AS deal_id, {_org('user_id')} AS organization_id,
       CASE event_type WHEN 'view' THEN 'email_in' WHEN 'click' THEN 'email_out' WHEN 'signup' THEN 'note' ELSE 'linkedin_in' END AS activity_type,
       event_type <> 'signup' AS bumps_last_activity, CASE WHEN event_id % 2 = 0 THEN 'ev:' || CAST(event_id AS STRING) END AS source_event_key, CAST(ts AS TIMESTAMP) AS created_at
FROM {{events}}
"""

# mail and network events, each delivered twice; every second key is stored already
CONTACT_EVENTS = f"""
SELECT {_org('user_id')} AS organization_id, 'ct' || CAST(user_id AS STRING) AS contact_id,
       CASE user_id % 4 WHEN 0 THEN 'email_in' WHEN 1 THEN 'email_out' WHEN 2 THEN 'linkedin_in' ELSE 'linkedin_out' END AS activity_type,
       CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'Event ' || event_type END AS title, ' ev:' || CAST(event_id AS STRING) || ' ' AS source_event_key,
       CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'system' END AS actor, 'user_' || CAST(user_id AS STRING) AS actor_user_id, CAST(ts AS TIMESTAMP) AS occurred_at
FROM {{events}}
UNION ALL
SELECT {_org('user_id')}, 'ct' || CAST(user_id AS STRING), CASE user_id % 4 WHEN 0 THEN 'email_in' WHEN 1 THEN 'email_out' WHEN 2 THEN 'linkedin_in' ELSE 'linkedin_out' END,
       'Event again', 'ev:' || CAST(event_id AS STRING), 'system', CAST(NULL AS STRING), CAST(ts AS TIMESTAMP) + INTERVAL '1' HOUR
FROM {{events}}
"""

PROJECTION_FAILURES = f"""
SELECT 'pf' || CAST(c_custkey AS STRING) AS id, {_org('c_custkey')} AS organization_id, CASE WHEN c_custkey % 2 = 0 THEN 'ct' ELSE 'gone' END || CAST(c_custkey AS STRING) AS contact_id,
       CASE WHEN c_custkey % 10 = 0 THEN {_day('c_custkey % 30', 'DAY')} END AS resolved_at
FROM {{customer}}
"""

# ---------------------------------------------------------------- onboarding

WORKSPACES = f"""
SELECT 'w' || CAST(c_custkey AS STRING) AS id, c_name AS name, c_custkey % 21 = 0 AS deleted,
       CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'researched' WHEN 2 THEN 'approved' ELSE 'launched' END AS onboarding_status,
       CASE WHEN c_custkey % 6 = 0 THEN {_day('c_custkey % 500')} END AS activated_at, c_custkey % 10 = 1 AS card_on_file,
       CASE WHEN c_custkey % 3 <> 0 THEN 'https://w' || CAST(c_custkey AS STRING) || '.example.com' END AS company_website, {_day('c_custkey % 700')} AS created_at
FROM {{customer}}
"""

ONBOARDING_EVENTS = """
SELECT 'fe' || CAST(event_id AS STRING) AS id, 'w' || CAST(user_id AS STRING) AS organization_id, 'user_' || CAST(user_id AS STRING) AS user_id,
       'user' || CAST(user_id AS STRING) || '@example.com' AS user_email,
       CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'researched' WHEN 'signup' THEN 'approved' WHEN 'purchase' THEN 'launched' ELSE 'kb_built' END AS to_status,
       CAST(ts AS TIMESTAMP) AS occurred_at
FROM {events}
"""

REENGAGEMENT_SENDS = f"""
SELECT 'rs' || CAST(c_custkey AS STRING) AS id, 'w' || CAST(c_custkey AS STRING) AS organization_id, 'step_' || CAST(c_custkey % 5 AS STRING) AS sequence_step,
       {_day('c_custkey % 600')} AS sent_at, CASE WHEN c_custkey % 2 = 0 THEN {_day('c_custkey % 600 + 2')} END AS opened_at,
       CASE WHEN c_custkey % 4 = 0 THEN {_day('c_custkey % 600 + 3')} END AS clicked_at, CASE WHEN c_custkey % 9 = 0 THEN {_day('c_custkey % 600 + 30')} END AS converted_at
FROM {{customer}}
"""

BROADCASTS = """SELECT 'bc' || CAST(n_nationkey AS STRING) AS id, 'Broadcast ' || n_name AS title FROM {nation}"""

BROADCAST_SENDS = """
SELECT 'bs' || CAST(event_id AS STRING) AS id, 'bc' || CAST(event_id % 23 AS STRING) AS broadcast_id,
       CASE event_type WHEN 'view' THEN 'sent' WHEN 'click' THEN 'pending' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'suppressed' ELSE 'sent' END AS status, CAST(ts AS TIMESTAMP) AS sent_at
FROM {events}
"""

EVENT_PAGES = f"""
SELECT 'ev' || CAST(n_nationkey AS STRING) AS id, {_org('n_nationkey')} AS organization_id, 'Event ' || n_name AS title, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey * 2 AS INT) END AS capacity FROM {{nation}}
"""

EVENT_REGISTRATIONS = f"""
SELECT 'er' || CAST(o_orderkey AS STRING) AS id, 'ev' || CAST(o_custkey % 24 AS STRING) AS event_id, {_org('o_custkey')} AS organization_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Person' ELSE 'person' END || CAST(o_custkey % 700 AS STRING) || '@example.com' AS email,
       CASE o_orderkey % 4 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'attended' ELSE 'registered' END AS status, CAST(o_orderdate AS TIMESTAMP) AS registered_at
FROM {{orders}}
"""

UNMATCHED_REPLIES = f"""
SELECT 'ur' || CAST(event_id AS STRING) AS id, {_org('user_id')} AS organization_id, CASE WHEN event_id % 10 <> 0 THEN 'mail-' || CAST(event_id - event_id % 3 AS STRING) END AS email_id,
       CASE event_id % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'ignored' ELSE 'unmatched' END AS resolution_status, CAST(ts AS TIMESTAMP) AS received_at
FROM {{events}}
"""

PROVIDER_EVENT_LOG = f"""
SELECT 'pe' || CAST(event_id AS STRING) AS id, {_org('user_id')} AS organization_id, 'provider:' || CAST(event_id - event_id % 4 AS STRING) AS dedup_key, 'mail' AS provider, event_type, props AS raw_payload,
       CAST(ts AS TIMESTAMP) AS occurred_at, CAST(ts AS TIMESTAMP) - (event_id % 120) * INTERVAL '1' DAY AS received_at
FROM {{events}}
"""

# ---------------------------------------------------------------- inbox and search

LINKEDIN_MESSAGES = f"""
SELECT 'm' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id, {_org('conv_id')} AS organization_id, 'chat' || CAST(conv_id AS STRING) AS chat_id,
       CASE WHEN role = 'user' OR turn % 4 = 3 THEN 'inbound' ELSE 'outbound' END AS direction, text AS body,
       TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' MINUTE + turn * INTERVAL '1' HOUR AS sent_at
FROM {{conversations}}
"""

LINKEDIN_THREADS = f"""
SELECT 'th' || CAST(c_custkey AS STRING) AS id, {_org('c_custkey')} AS organization_id, CASE WHEN c_custkey % 3 <> 0 THEN 'ct' || CAST(c_custkey AS STRING) END AS contact_id,
       CASE c_custkey % 4 WHEN 0 THEN 'outbound' WHEN 1 THEN 'campaign_inbound' WHEN 2 THEN 'unrelated_inbound' END AS thread_origin,
       CASE WHEN c_custkey % 7 = 0 THEN 'archived' ELSE 'active' END AS thread_status, {_day('c_custkey % 800')} AS last_message_at
FROM {{customer}}
"""

CHUNKS = f"""
SELECT 'ch' || CAST(doc_id AS STRING) AS id, {_org('doc_id')} AS organization_id, 'file' || CAST(doc_id % 20 AS STRING) AS file_id, 'https://example.com/' || CAST(doc_id AS STRING) AS url, text AS chunk_text, embedding
FROM {{documents}} LEFT JOIN {{embeddings}} ON doc_id = vec_id
"""

# ---------------------------------------------------------------- settings, style, files

ICP_SETTINGS = """
SELECT 'w' || CAST(c_custkey AS STRING) AS organization_id,
       CASE c_custkey % 6
         WHEN 0 THEN '{{"company_criteria":{{"company_size":{{"min_employees":' || CAST(c_custkey % 50 AS STRING) || ',"max_employees":900}},"sales_process":["inbound"]}},"industries":{{"Software":1,"Energy":2}},"geography":{{"primary_regions":["EU"],"focus_areas":["DACH"]}}}}'
         WHEN 1 THEN '{{"industries":["Retail","Retail2"],"preferred_job_titles":["CEO","CTO"],"pain_points":["cost"],"current_customers":["https://linkedin.com/company/a' || CAST(c_custkey % 9 AS STRING) || '","https://linkedin.com/in/b"]}}'
         WHEN 2 THEN '{{"company_criteria":{{"company_size":{{"max_employees":50}}}},"ideal_customers":["https://linkedin.com/company/x","https://linkedin.com/company/x"],"ideal_persons":["https://linkedin.com/in/p' || CAST(c_custkey % 5 AS STRING) || '"],"exclusion_list":["https://linkedin.com/company/z"]}}'
         WHEN 3 THEN '{{"ideal_clients":["https://linkedin.com/company/q","https://linkedin.com/in/r","https://example.com"],"industries":' || CASE c_custkey % 4 WHEN 1 THEN replace('"a ~"b~" c"', '~', chr(92)) WHEN 3 THEN '17' ELSE '"none"' END || '}}'
         WHEN 4 THEN '{{"geography":{{"secondary_regions":["US","UK"]}}}}' END AS icp_settings
FROM {customer}
"""

STYLE_GUIDELINES = """
SELECT 'st' || CAST(p_partkey AS STRING) AS id,
       CASE p_partkey % 4 WHEN 0 THEN '{{"farm_agrarian":["soil"],"natural_environment":["green' || CAST(p_partkey % 5 AS STRING) || '"],"brand_identity":["own"]}}'
         WHEN 1 THEN '{{"activity_fun":["play"],"social_leisure":["club"],"custom_words":["x"]}}' WHEN 2 THEN '{{"value_proposition":["save","save"],"business_growth":["grow"]}}' END AS lexical_fields,
       CASE p_partkey % 3 WHEN 0 THEN '[{{"term":"A","category":"Product Features"}},{{"term":"B","category":"My product words"}},{{"term":"C","category":"avoid"}}]'
         WHEN 1 THEN '[{{"term":"D","category":"Industry jargon"}},{{"term":"E","category":"negative"}},{{"term":"F","category":"Technology"}}]' END AS dictionary,
       CASE WHEN p_partkey % 2 = 0 THEN 'warm,calm' END AS emotions_text, CASE WHEN p_partkey % 5 <> 0 THEN 'calm,bold' END AS traits_text
FROM {part}
"""

STORED_FILES = f"""
SELECT 'f' || CAST(r_regionkey AS STRING) AS id, {_org('r_regionkey')} AS organization_id FROM {{region}} WHERE r_regionkey <> 2
"""

FILE_LINKS = f"""
SELECT 'fl' || CAST(p_partkey AS STRING) AS id, {_org('p_partkey')} AS organization_id, 'f' || CAST(p_partkey % 6 AS STRING) AS file_id FROM {{part}}
"""

OBJECTS_BEFORE = """
SELECT 'documents' AS bucket_id, 'page/' || CAST(page_id AS STRING) AS name, 'v1' AS version, CAST(length(html) AS BIGINT) AS size, 'e' || CAST(page_id AS STRING) AS etag, 'text/html' AS mimetype,
       CAST(NULL AS STRING) AS cache_control, CASE WHEN page_id % 4 = 0 THEN '{{"a":1}}' END AS user_metadata
FROM {pages} WHERE page_id % 10 <> 9
"""

OBJECTS_AFTER = """
SELECT 'documents' AS bucket_id, 'page/' || CAST(page_id AS STRING) AS name, CASE WHEN page_id % 8 = 1 THEN 'v2' ELSE 'v1' END AS version, CAST(length(html) + page_id % 2 AS BIGINT) AS size, 'e' || CAST(page_id AS STRING) AS etag,
       'text/html' AS mimetype, CASE WHEN page_id % 6 = 2 THEN '' END AS cache_control, CASE WHEN page_id % 4 = 0 THEN '{{"a":1}}' WHEN page_id % 4 = 2 THEN '{{}}' END AS user_metadata
FROM {pages} WHERE page_id % 10 <> 3
"""

ADAPTERS = {
    "workspaces": WORKSPACES,
    "onboarding_events": ONBOARDING_EVENTS,
    "reengagement_sends": REENGAGEMENT_SENDS,
    "broadcasts": BROADCASTS,
    "broadcast_sends": BROADCAST_SENDS,
    "event_pages": EVENT_PAGES,
    "event_registrations": EVENT_REGISTRATIONS,
    "unmatched_replies": UNMATCHED_REPLIES,
    "provider_event_log": PROVIDER_EVENT_LOG,
    "linkedin_messages": LINKEDIN_MESSAGES,
    "linkedin_threads": LINKEDIN_THREADS,
    "chunks": CHUNKS,
    "icp_settings_rows": ICP_SETTINGS,
    "style_guidelines": STYLE_GUIDELINES,
    "stored_files": STORED_FILES,
    "file_links": FILE_LINKS,
    "objects_before": OBJECTS_BEFORE,
    "objects_after": OBJECTS_AFTER,
    "deals": DEALS,
    "deals_after": DEALS_AFTER,
    "deal_tasks": DEAL_TASKS,
    "deal_activities": DEAL_ACTIVITIES,
    "contact_events": CONTACT_EVENTS,
    "projection_failures": PROJECTION_FAILURES,
    "campaign_contacts": CAMPAIGN_CONTACTS,
    "sequence_actions": SEQUENCE_ACTIONS,
    "campaign_activities": CAMPAIGN_ACTIVITIES,
    "email_status_changes": EMAIL_STATUS_CHANGES,
    "typed_documents": TYPED_DOCUMENTS,
    "outreach_candidates": OUTREACH_CANDIDATES,
    "suppressions": SUPPRESSIONS,
    "reply_drafts": REPLY_DRAFTS,
    "raw_updates": RAW_UPDATES,
    "crm_raw_records": CRM_RAW_RECORDS,
    "crm_list_members": CRM_LIST_MEMBERS,
    "email_copy_drafts": EMAIL_COPY_DRAFTS,
    "billing_invoices": BILLING_INVOICES,
    "billing_customers": BILLING_CUSTOMERS,
    "discount_codes": DISCOUNT_CODES,
    "discount_redemptions": DISCOUNT_REDEMPTIONS,
    "tasks": TASKS,
    "campaign_emails": CAMPAIGN_EMAILS,
    "email_reply_events": EMAIL_REPLY_EVENTS,
    "short_urls": SHORT_URLS,
    "document_access_events": DOCUMENT_ACCESS_EVENTS,
    "linkedin_action_log": LINKEDIN_ACTION_LOG,
    "agent_runs": AGENT_RUNS,
    "token_usage": TOKEN_USAGE,
    "organization": ORGANIZATION,
    "organization_settings": ORGANIZATION_SETTINGS,
    "members": MEMBERS,
    "contacts": CONTACTS,
    "companies": COMPANIES,
    "company_contacts": COMPANY_CONTACTS,
    "campaigns": CAMPAIGNS,
    "campaign_companies": CAMPAIGN_COMPANIES,
    "usage": USAGE,
}


def dependencies(text: str) -> list[str]:
    """Table names a SELECT refers to."""
    return list(dict.fromkeys(f for _, f, _, _ in string.Formatter().parse(text) if f))


def cte_chain(names) -> list[tuple[str, str]]:
    """(name, SELECT) of the derived tables needed for `names`, dependencies first."""
    out: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in BASE_TABLES or name in out:
            return
        text = ADAPTERS[name]
        needs = dependencies(text)
        for need in needs:
            visit(need)
        out[name] = text.format(**{n: n for n in needs})

    for name in names:
        visit(name)
    return list(out.items())
