"""Registered funnel queries and their oracles."""

from pyspark.sql import functions as F

from ledgerlark.operators import funnel as P
from ledgerlark.plans.registry import query


def _firms(t):
    return t.companies.withColumn("industries", F.split("industry_text", ","))


@query(
    "funnel_stages",
    """WITH s AS (SELECT organization_id, upper(coalesce(nullif(trim(pipeline_stage), ''), 'Unknown')) AS stage, count(*) AS contacts FROM contacts GROUP BY 1, 2)
    SELECT *, CAST(round(CAST(contacts * 100 AS DECIMAL(30,10)) / sum(contacts) OVER (PARTITION BY organization_id), 2) AS DECIMAL(12,2)) AS percentage FROM s""",
)
def _stages(t):
    return P.stages(t.contacts)


@query(
    "funnel_conversion",
    """WITH c AS (SELECT organization_id, upper(pipeline_stage) AS s FROM contacts),
    n AS (SELECT organization_id, count(*) AS total_contacts,
      count(*) FILTER (WHERE s IN ('LEAD','APPOINTMENT_REQUESTED','APPOINTMENT_SCHEDULED','APPOINTMENT_CANCELLED','PRESENTATION_SCHEDULED','CONTRACT_NEGOTIATIONS','AGREEMENT_IN_PRINCIPLE','CLOSED_WON','CLOSED_LOST','REENGAGEMENT')) AS reached_lead,
      count(*) FILTER (WHERE s IN ('APPOINTMENT_REQUESTED','APPOINTMENT_SCHEDULED','APPOINTMENT_CANCELLED','PRESENTATION_SCHEDULED','CONTRACT_NEGOTIATIONS','AGREEMENT_IN_PRINCIPLE','CLOSED_WON','CLOSED_LOST','REENGAGEMENT')) AS reached_appointment,
      count(*) FILTER (WHERE s IN ('APPOINTMENT_SCHEDULED','APPOINTMENT_CANCELLED','PRESENTATION_SCHEDULED','CONTRACT_NEGOTIATIONS','AGREEMENT_IN_PRINCIPLE','CLOSED_WON','CLOSED_LOST','REENGAGEMENT')) AS reached_scheduled,
      count(*) FILTER (WHERE s IN ('PRESENTATION_SCHEDULED','CONTRACT_NEGOTIATIONS','AGREEMENT_IN_PRINCIPLE','CLOSED_WON')) AS reached_presentation FROM c GROUP BY 1)
    SELECT *, CAST(coalesce(round(CAST(reached_lead * 100 AS DECIMAL(30,10)) / nullif(total_contacts, 0), 2), 0) AS DECIMAL(12,2)) AS prospect_to_lead,
      CAST(coalesce(round(CAST(reached_appointment * 100 AS DECIMAL(30,10)) / nullif(reached_lead, 0), 2), 0) AS DECIMAL(12,2)) AS lead_to_appointment,
      CAST(coalesce(round(CAST(reached_presentation * 100 AS DECIMAL(30,10)) / nullif(reached_scheduled, 0), 2), 0) AS DECIMAL(12,2)) AS appointment_to_presentation FROM n""",
)
def _conversion(t):
    return P.conversion(t.contacts)


_TOP = """ranked AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY contacts DESC, {k}) AS r FROM c),
  top AS (SELECT * EXCLUDE (r) FROM ranked WHERE r <= 10)
  SELECT *, CAST(round(CAST(contacts * 100 AS DECIMAL(30,10)) / sum(contacts) OVER (PARTITION BY organization_id), 2) AS DECIMAL(12,2)) AS percentage FROM top"""


@query(
    "funnel_top_industries",
    """WITH f AS (SELECT DISTINCT organization_id, id, unnest(string_split(industry_text, ',')) AS industry FROM companies),
    c AS (SELECT f.organization_id, industry, count(DISTINCT cc.id) AS contacts FROM f JOIN company_contacts cc ON cc.company_id = f.id AND cc.organization_id = f.organization_id GROUP BY 1, 2),
    """ + _TOP.format(k="industry"),
)
def _industries(t):
    return P.top_industries(_firms(t), t.company_contacts)


@query(
    "funnel_top_locations",
    "WITH c AS (SELECT organization_id, location, count(*) AS contacts FROM contacts WHERE location <> '' GROUP BY 1, 2), " + _TOP.format(k="location"),
)
def _locations(t):
    return P.top_locations(t.contacts)


@query(
    "funnel_company_coverage",
    """WITH n AS (SELECT c.organization_id, c.id, count(cc.id) AS links FROM companies c LEFT JOIN company_contacts cc ON cc.company_id = c.id AND cc.organization_id = c.organization_id GROUP BY 1, 2)
    SELECT organization_id, count(*) AS total_companies, count(*) FILTER (WHERE links > 0) AS companies_with_contacts,
      CAST(round(CAST(sum(links) AS DECIMAL(30,10)) / count(*), 2) AS DECIMAL(12,2)) AS average_contacts_per_company FROM n GROUP BY 1""",
)
def _coverage(t):
    return P.company_coverage(t.companies, t.company_contacts)
