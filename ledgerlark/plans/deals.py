"""Registered deal queries and their oracles."""

from pyspark.sql import functions as F

from ledgerlark.operators import cdc
from ledgerlark.operators import deals as D
from ledgerlark.plans.registry import query

AS_OF = "2024-05-01 00:00:00"

_MAP = """CASE upper(pipeline_stage) WHEN 'LEAD' THEN 'LEAD' WHEN 'REENGAGEMENT' THEN 'LEAD' WHEN 'APPOINTMENT_REQUESTED' THEN 'MEETING_REQUESTED' WHEN 'APPOINTMENT_CANCELLED' THEN 'MEETING_REQUESTED'
  WHEN 'APPOINTMENT_SCHEDULED' THEN 'MEETING_BOOKED' WHEN 'PRESENTATION_SCHEDULED' THEN 'PRESENTATION' WHEN 'CONTRACT_NEGOTIATIONS' THEN 'NEGOTIATION' WHEN 'AGREEMENT_IN_PRINCIPLE' THEN 'AGREEMENT'
  WHEN 'CLOSED_LOST' THEN 'LOST' WHEN 'NOT_INTERESTED' THEN 'LOST' END"""


def _level(e: str) -> str:
    return f"coalesce(list_position(['LOST','LEAD','MEETING_REQUESTED','MEETING_BOOKED','PRESENTATION','NEGOTIATION','AGREEMENT','WON'], upper({e})), 0) - 1"


_BASE = f"""c0 AS (SELECT *, {_MAP} AS ds, greatest(stage_updated_at, last_incoming_email_at) AS seen FROM contacts),
c1 AS (SELECT *, {_level('ds')} AS lv FROM c0),
act AS (SELECT * FROM c1 WHERE ds IN ('LEAD','MEETING_REQUESTED','MEETING_BOOKED','PRESENTATION','NEGOTIATION','AGREEMENT')),
newest AS (SELECT l.organization_id, l.contact_id, l.company_id, f.name AS company_name, f.owner_user_id AS company_owner FROM company_contacts l JOIN companies f ON f.id = l.company_id AND f.organization_id = l.organization_id
  QUALIFY row_number() OVER (PARTITION BY l.organization_id, l.contact_id ORDER BY l.created_at DESC NULLS LAST, l.id DESC) = 1),
mem AS (SELECT DISTINCT organization_id, user_id FROM members),
camp AS (SELECT cc.organization_id, cc.company_id, min(k.id) AS campaign, min(k.user_id) AS campaign_owner FROM campaign_companies cc JOIN campaigns k ON k.id = cc.campaign_id AND k.organization_id = cc.organization_id
  GROUP BY 1, 2 HAVING count(DISTINCT k.id) = 1),
cand AS (SELECT a.organization_id, n.company_id, company_name, a.id AS contact_id, a.pipeline_stage, a.ds, a.lv, a.seen, a.stage_updated_at, a.created_at, m.user_id AS own, mc.user_id AS company_owner, mk.user_id AS campaign_owner, campaign,
    row_number() OVER (PARTITION BY a.organization_id, n.company_id ORDER BY a.stage_updated_at NULLS FIRST, a.created_at, a.id) AS pos
  FROM act a JOIN newest n ON n.contact_id = a.id AND n.organization_id = a.organization_id LEFT JOIN camp ON camp.company_id = n.company_id AND camp.organization_id = n.organization_id
    LEFT JOIN mem m ON m.user_id = a.assigned_to_user_id AND m.organization_id = a.organization_id LEFT JOIN mem mc ON mc.user_id = n.company_owner AND mc.organization_id = a.organization_id
    LEFT JOIN mem mk ON mk.user_id = campaign_owner AND mk.organization_id = a.organization_id),
comp AS (SELECT organization_id, company_id, max(company_name) AS company_name, min_by(contact_id, pos) AS first_contact, arg_min_null(seen, pos) AS first_seen, max(lv) AS top_level, min_by(contact_id, (-lv, pos)) AS top_contact,
    min_by(ds, (-lv, pos)) AS top_stage, max(campaign) AS campaign, coalesce(max(own) FILTER (WHERE pos = 1), max(company_owner), max(campaign_owner), min_by(own, pos) FILTER (WHERE own IS NOT NULL)) AS owner
  FROM cand GROUP BY 1, 2),
best AS (SELECT l.organization_id, l.company_id, a.id AS best_contact, a.lv AS best_level FROM act a JOIN company_contacts l ON l.contact_id = a.id AND l.organization_id = a.organization_id
  QUALIFY row_number() OVER (PARTITION BY l.organization_id, l.company_id ORDER BY a.lv DESC, a.seen DESC NULLS LAST, a.id) = 1)"""

_PROJECTED = f"""{_BASE},
grown AS (SELECT d.* REPLACE (CASE WHEN up THEN top_stage ELSE stage END AS stage, CASE WHEN up THEN top_contact ELSE stage_contact_id END AS stage_contact_id, coalesce(owner_user_id, owner) AS owner_user_id,
    CASE WHEN up OR (owner_user_id IS NULL AND owner IS NOT NULL) THEN coalesce(source_campaign_id, campaign) ELSE source_campaign_id END AS source_campaign_id)
  FROM (SELECT d.*, comp.* EXCLUDE (organization_id, company_id), coalesce(top_level > {_level('stage')}, FALSE) AS up FROM deals d LEFT JOIN comp ON comp.company_id = d.company_id AND comp.organization_id = d.organization_id WHERE closed_at IS NULL) d),
miss AS (SELECT comp.*, default_deal_amount, coalesce(default_deal_currency, 'USD') AS cur FROM comp LEFT JOIN organization_settings s ON s.organization_id = comp.organization_id
  WHERE NOT EXISTS (SELECT 1 FROM deals d WHERE d.closed_at IS NULL AND d.company_id = comp.company_id AND d.organization_id = comp.organization_id)),
projected AS (
  SELECT id, organization_id, company_id, primary_contact_id, stage_contact_id, source_campaign_id, owner_user_id, name, stage, amount, currency, creation_source, last_activity_at, closed_at FROM deals WHERE closed_at IS NOT NULL
  UNION ALL SELECT id, organization_id, company_id, primary_contact_id, stage_contact_id, source_campaign_id, owner_user_id, name, stage, amount, currency, creation_source, last_activity_at, closed_at FROM grown
  UNION ALL SELECT 'new:' || company_id, organization_id, company_id, first_contact, top_contact, campaign, owner, company_name, top_stage, default_deal_amount, cur, 'automatic', coalesce(first_seen, TIMESTAMP '{AS_OF}'), NULL FROM miss WHERE trim(company_name) <> '')"""

_COLUMNS = ["id", "organization_id", "company_id", "primary_contact_id", "stage_contact_id", "source_campaign_id", "owner_user_id", "name", "stage", "amount", "currency", "creation_source", "last_activity_at", "closed_at"]


def _inputs(t):
    return (t.contacts, t.company_contacts, t.companies, t.campaigns, t.campaign_companies, t.organization_settings, t.members, t.deals, AS_OF)


@query("deals_project", f"WITH {_PROJECTED} SELECT * FROM projected")
def _project(t):
    return D.project(*_inputs(t))[0].select(*_COLUMNS)


@query(
    "deals_projection_failures",
    f"""WITH {_PROJECTED} SELECT c.organization_id, contact_id, pipeline_stage AS contact_stage, 'deal name is blank' AS error_message FROM miss m JOIN cand c ON c.company_id = m.company_id AND c.organization_id = m.organization_id
    WHERE trim(m.company_name) = ''""",
)
def _failures(t):
    return D.projection_failures(*_inputs(t))


@query(
    "deals_close_lost",
    f"""WITH {_BASE},
    lost AS (SELECT n.organization_id, n.company_id, c.id, c.stage_updated_at, c.created_at FROM c1 c JOIN newest n ON n.contact_id = c.id AND n.organization_id = c.organization_id WHERE ds = 'LOST'),
    fl AS (SELECT organization_id, company_id, id AS lost_contact FROM lost QUALIFY row_number() OVER (PARTITION BY organization_id, company_id ORDER BY stage_updated_at NULLS FIRST, created_at, id) = 1),
    j AS (SELECT d.*, lost_contact, best_contact, EXISTS (SELECT 1 FROM lost l WHERE l.organization_id = d.organization_id AND l.company_id = d.company_id AND l.id = d.primary_contact_id) AS pl
      FROM deals d LEFT JOIN fl ON fl.company_id = d.company_id AND fl.organization_id = d.organization_id LEFT JOIN best b ON b.company_id = d.company_id AND b.organization_id = d.organization_id)
    SELECT id, CASE WHEN closed_at IS NULL AND pl AND best_contact IS NOT NULL THEN best_contact ELSE primary_contact_id END AS primary_contact_id,
      CASE WHEN closed_at IS NULL AND lost_contact IS NOT NULL AND best_contact IS NULL THEN lost_contact ELSE stage_contact_id END AS stage_contact_id,
      CASE WHEN closed_at IS NULL AND lost_contact IS NOT NULL AND best_contact IS NULL THEN 'LOST' ELSE stage END AS stage,
      CASE WHEN closed_at IS NULL AND lost_contact IS NOT NULL AND best_contact IS NULL THEN TIMESTAMP '{AS_OF}' ELSE closed_at END AS closed_at FROM j""",
)
def _lost(t):
    return D.close_lost(t.contacts, t.company_contacts, t.companies, t.deals, AS_OF).select("id", "primary_contact_id", "stage_contact_id", "stage", "closed_at")


@query(
    "deals_reconcile",
    f"""WITH {_PROJECTED} SELECT p.* EXCLUDE (last_activity_at, primary_contact_id), CASE WHEN closed_at IS NULL THEN coalesce(best_contact, primary_contact_id) ELSE primary_contact_id END AS primary_contact_id,
      CASE WHEN closed_at IS NULL AND creation_source = 'automatic' THEN greatest(last_activity_at, TIMESTAMP '{AS_OF}' - INTERVAL 13 DAY) ELSE last_activity_at END AS last_activity_at
    FROM projected p LEFT JOIN best b ON b.company_id = p.company_id AND b.organization_id = p.organization_id""",
)
def _reconcile(t):
    return D.reconcile(*_inputs(t))[0].select(*_COLUMNS)


@query(
    "deals_reconcile_counters",
    f"""WITH {_PROJECTED},
    bad AS (SELECT c.organization_id, contact_id FROM miss m JOIN cand c ON c.company_id = m.company_id AND c.organization_id = m.organization_id WHERE trim(m.company_name) = ''),
    n AS (SELECT a.organization_id, count(*) FILTER (WHERE n.contact_id IS NOT NULL AND bad.contact_id IS NULL) AS projected, count(*) FILTER (WHERE n.contact_id IS NULL) AS skipped, count(bad.contact_id) AS failed
      FROM act a LEFT JOIN newest n ON n.contact_id = a.id AND n.organization_id = a.organization_id LEFT JOIN bad ON bad.contact_id = a.id AND bad.organization_id = a.organization_id GROUP BY 1)
    SELECT n.*, (SELECT count(*) FROM projected p WHERE p.organization_id = n.organization_id AND closed_at IS NULL AND creation_source = 'automatic') AS activity_clock_floored FROM n""",
)
def _counters(t):
    return D.reconcile(*_inputs(t))[2]


@query(
    "deals_readiness",
    f"""WITH {_BASE}, o AS (SELECT *, {_level('stage')} AS dl FROM deals WHERE closed_at IS NULL),
    r AS (SELECT w.id AS organization_id, EXISTS (SELECT 1 FROM organization_settings s WHERE s.organization_id = w.id) AS organization_settings_present,
      (SELECT count(*) FROM act a JOIN company_contacts l ON l.contact_id = a.id AND l.organization_id = a.organization_id WHERE a.organization_id = w.id) AS eligible_contact_count,
      (SELECT count(*) FROM best b WHERE b.organization_id = w.id) AS eligible_company_count,
      (SELECT count(*) FROM o WHERE o.organization_id = w.id) AS existing_open_deal_count,
      (SELECT count(*) FROM best b WHERE b.organization_id = w.id AND NOT EXISTS (SELECT 1 FROM o WHERE o.company_id = b.company_id AND o.organization_id = b.organization_id)) AS missing_deal_count,
      (SELECT count(*) FROM best b JOIN o ON o.company_id = b.company_id AND o.organization_id = b.organization_id WHERE b.organization_id = w.id AND o.dl < b.best_level) AS lagging_stage_count,
      (SELECT count(*) FROM best b JOIN o ON o.company_id = b.company_id AND o.organization_id = b.organization_id WHERE b.organization_id = w.id AND o.primary_contact_id IS DISTINCT FROM best_contact) AS primary_contact_mismatch_count,
      (SELECT count(*) FROM (SELECT company_id FROM o WHERE o.organization_id = w.id GROUP BY 1 HAVING count(*) > 1)) AS duplicate_open_deal_count,
      (SELECT count(*) FROM projection_failures f WHERE f.organization_id = w.id AND resolved_at IS NULL) AS unresolved_projection_failure_count FROM organization w)
    SELECT *, missing_deal_count + lagging_stage_count + primary_contact_mismatch_count + duplicate_open_deal_count + unresolved_projection_failure_count = 0 AS ready_for_flag_enablement FROM r""",
)
def _readiness(t):
    return D.readiness(t.organization, t.organization_settings, t.contacts, t.company_contacts, t.deals, t.projection_failures)


@query(
    "deals_resolve_failures",
    f"""WITH {_BASE}, o AS (SELECT *, {_level('stage')} AS dl FROM deals WHERE closed_at IS NULL)
    SELECT f.id, CASE WHEN f.resolved_at IS NULL AND (coalesce(c.ds = 'LOST', FALSE) OR EXISTS (SELECT 1 FROM company_contacts l JOIN o ON o.company_id = l.company_id AND o.organization_id = l.organization_id
      WHERE l.contact_id = c.id AND l.organization_id = c.organization_id AND o.dl >= c.lv)) THEN TIMESTAMP '{AS_OF}' ELSE f.resolved_at END AS resolved_at
    FROM projection_failures f LEFT JOIN c1 c ON c.id = f.contact_id AND c.organization_id = f.organization_id""",
)
def _resolve(t):
    return D.resolve_failures(t.projection_failures, t.contacts, t.company_contacts, t.deals, AS_OF).select("id", "resolved_at")


# ---------------------------------------------------------------- changes

_CHANGED = "j AS (SELECT n.*, o.id AS old_id, o.stage AS o_stage, o.amount AS o_amount, o.currency AS o_currency, o.owner_user_id AS o_owner, o.nurture_enabled AS o_nurture, o.snoozed_until AS o_snooze, o.closed_at AS o_closed FROM deals_after n LEFT JOIN deals o ON o.id = n.id AND o.organization_id = n.organization_id)"


@query(
    "deals_audit",
    f"""WITH {_CHANGED}
    SELECT id AS deal_id, 'deal_created' AS activity_type, 'Deal created' AS title, FALSE AS bumps_last_activity, primary_contact_id AS contact_id, stage AS to_value FROM j WHERE old_id IS NULL
    UNION ALL SELECT id, 'stage_change', 'Deal stage changed', TRUE, stage_contact_id, stage FROM j WHERE old_id IS NOT NULL AND stage IS DISTINCT FROM o_stage
    UNION ALL SELECT id, 'amount_change', 'Deal value changed', FALSE, NULL, CAST(amount AS VARCHAR) FROM j WHERE old_id IS NOT NULL AND (amount IS DISTINCT FROM o_amount OR currency IS DISTINCT FROM o_currency)
    UNION ALL SELECT id, 'owner_change', 'Deal owner changed', FALSE, NULL, owner_user_id FROM j WHERE old_id IS NOT NULL AND owner_user_id IS DISTINCT FROM o_owner
    UNION ALL SELECT id, 'nurture_change', 'Deal nurture setting changed', FALSE, NULL, CAST(nurture_enabled AS VARCHAR) FROM j WHERE old_id IS NOT NULL AND nurture_enabled IS DISTINCT FROM o_nurture
    UNION ALL SELECT id, 'snooze_change', CASE WHEN snoozed_until IS NULL THEN 'Deal snooze cleared' ELSE 'Deal snoozed' END, FALSE, NULL, strftime(snoozed_until, '%Y-%m-%dT%H:%M:%S.000Z') FROM j WHERE old_id IS NOT NULL AND snoozed_until IS DISTINCT FROM o_snooze""",
)
def _audit(t):
    at = lambda key: F.get_json_object("metadata", f"$.{key}")
    value = F.coalesce(at("to"), at("to_amount").cast("decimal(14,2)").cast("string"), at("enabled"), at("stage"))
    return D.audit(t.deals, t.deals_after).select("deal_id", "activity_type", "title", "bumps_last_activity", "contact_id", value.alias("to_value"))


@query(
    "deals_change_feed",
    """SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'INSERT' WHEN n.id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS event_type, o.stage AS old_stage, n.stage AS new_stage,
      CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL THEN concat_ws(',', CASE WHEN n.amount IS DISTINCT FROM o.amount THEN 'amount' END, CASE WHEN n.owner_user_id IS DISTINCT FROM o.owner_user_id THEN 'owner_user_id' END,
        CASE WHEN n.stage IS DISTINCT FROM o.stage THEN 'stage' END) END AS changed,
      CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL AND n.owner_user_id IS DISTINCT FROM o.owner_user_id THEN coalesce(o.owner_user_id, '-') || '>' || coalesce(n.owner_user_id, '-') END AS owner_change
    FROM (SELECT id, organization_id, stage, amount, owner_user_id FROM deals) o FULL JOIN (SELECT id, organization_id, stage, amount, owner_user_id FROM deals_after) n ON n.id = o.id AND n.organization_id = o.organization_id
    WHERE o.id IS NULL OR n.id IS NULL OR n.amount IS DISTINCT FROM o.amount OR n.owner_user_id IS DISTINCT FROM o.owner_user_id OR n.stage IS DISTINCT FROM o.stage""",
)
def _feed(t):
    pick = lambda df: df.select("id", "organization_id", "stage", "amount", "owner_user_id")
    feed = cdc.change_feed(pick(t.deals), pick(t.deals_after), ["id", "organization_id"])
    owner = F.col("changes")["owner_user_id"]
    shown = F.when(owner.isNotNull(), F.concat(F.coalesce(owner["old"], F.lit("-")), F.lit(">"), F.coalesce(owner["new"], F.lit("-"))))
    return feed.select(
        "id", "event_type", F.get_json_object("old", "$.stage").alias("old_stage"), F.get_json_object("new", "$.stage").alias("new_stage"),
        F.array_join(F.array_sort(F.map_keys("changes")), ",").alias("changed"), shown.alias("owner_change"),
    )


_PLACED = """r AS (SELECT *, trim(source_event_key) AS k, coalesce(nullif(trim(title), ''), 'Deal activity') AS ttl FROM contact_events),
ch AS (SELECT l.organization_id, l.contact_id, d.id AS deal_id FROM (SELECT DISTINCT organization_id, contact_id, company_id FROM company_contacts) l JOIN deals d ON d.company_id = l.company_id AND d.organization_id = l.organization_id AND d.closed_at IS NULL
  QUALIFY row_number() OVER (PARTITION BY l.organization_id, l.contact_id ORDER BY coalesce(d.primary_contact_id = l.contact_id, FALSE) DESC, d.stage_updated_at DESC, d.id) = 1),
p AS (SELECT r.*, deal_id FROM r JOIN ch ON ch.contact_id = r.contact_id AND ch.organization_id = r.organization_id)"""


@query(
    "deals_attach_activity",
    f"""WITH {_PLACED}, f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY organization_id, k ORDER BY occurred_at, contact_id, activity_type) = 1)
    SELECT deal_id, organization_id, activity_type, actor, CASE WHEN actor = 'user' THEN actor_user_id END AS actor_user_id, contact_id, ttl AS title, TRUE AS bumps_last_activity, k AS source_event_key, occurred_at AS created_at
    FROM f WHERE NOT EXISTS (SELECT 1 FROM deal_activities a WHERE a.organization_id = f.organization_id AND a.source_event_key = f.k)""",
)
def _attach(t):
    return D.attach_activity(t.contact_events, t.deals, t.company_contacts, t.deal_activities)[0]


@query(
    "deals_last_activity",
    """SELECT d.id, greatest(last_activity_at, m) AS last_activity_at FROM deals d LEFT JOIN (SELECT organization_id, deal_id, max(created_at) AS m FROM deal_activities WHERE bumps_last_activity GROUP BY 1, 2) a
      ON a.deal_id = d.id AND a.organization_id = d.organization_id""",
)
def _last(t):
    return D.last_activity(t.deals, t.deal_activities).select("id", "last_activity_at")


@query(
    "deals_task_effects",
    f"""WITH {_CHANGED}, e AS (SELECT organization_id, id AS deal_id, owner_user_id IS DISTINCT FROM o_owner AS re, owner_user_id, closed_at IS NOT NULL AND o_closed IS NULL AS cl, stage FROM j WHERE old_id IS NOT NULL)
    SELECT t.id, CASE WHEN t.status IN ('pending','in_progress','scheduled','in_review') AND re THEN e.owner_user_id ELSE assigned_to_user_id END AS assigned_to_user_id,
      CASE WHEN t.status IN ('pending','in_progress','scheduled','in_review') AND cl AND task_type IN ('nurture_reminder','linkedin_connect','manual_outreach') THEN 'cancelled' ELSE t.status END AS status,
      CASE WHEN t.status IN ('pending','in_progress','scheduled','in_review') AND cl AND task_type IN ('nurture_reminder','linkedin_connect','manual_outreach') THEN stage END AS deal_stage,
      t.metadata ->> '$.n' AS n
    FROM deal_tasks t LEFT JOIN e ON e.deal_id = t.deal_id AND e.organization_id = t.organization_id""",
)
def _effects(t):
    return D.task_effects(t.deals, t.deals_after, t.deal_tasks).select(
        "id", "assigned_to_user_id", "status", F.get_json_object("metadata", "$.deal_stage").alias("deal_stage"), F.get_json_object("metadata", "$.n").alias("n")
    )


_TITLE = "array_to_string(list_transform(string_split(lower(stage), '_'), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(
    "deals_notifications",
    f"""WITH {_CHANGED}, e AS (SELECT j.* FROM j JOIN organization_settings s ON s.organization_id = j.organization_id AND s.crm_pipeline_enabled WHERE owner_user_id IS NOT NULL)
    SELECT organization_id, owner_user_id AS user_id, id AS entity_id, 'deal_created' AS type, 'New deal: ' || name AS title, 'A deal entered the ' || {_TITLE} || ' stage.' AS body, 'deal_created:' || id AS dedup_key FROM e WHERE old_id IS NULL
    UNION ALL SELECT organization_id, owner_user_id, id, 'deal_owner_changed', 'Deal assigned: ' || name, 'You are now responsible for this deal and its open tasks.', 'deal_owner:' || id || ':' || owner_user_id FROM e WHERE old_id IS NOT NULL AND owner_user_id IS DISTINCT FROM o_owner
    UNION ALL SELECT organization_id, owner_user_id, id, 'deal_stage_changed', 'Deal advanced: ' || name, 'The deal moved to ' || {_TITLE} || '.', 'deal_stage:' || id || ':' || stage FROM e WHERE old_id IS NOT NULL AND stage IS DISTINCT FROM o_stage""",
)
def _notify(t):
    return D.notifications(t.deals, t.deals_after, t.organization_settings)


@query(
    "deals_nurture_due",
    """SELECT d.id, d.organization_id, last_activity_at FROM deals d JOIN organization_settings s ON s.organization_id = d.organization_id AND s.crm_automation_enabled
    WHERE closed_at IS NULL AND nurture_enabled AND (snoozed_until IS NULL OR snoozed_until <= TIMESTAMP '2024-02-20') AND last_activity_at <= TIMESTAMP '2024-02-20' - INTERVAL 14 DAY
      AND NOT EXISTS (SELECT 1 FROM deal_tasks t WHERE t.deal_id = d.id AND t.organization_id = d.organization_id AND task_type IN ('nurture_reminder','linkedin_connect') AND status IN ('pending','in_progress','scheduled','in_review'))""",
)
def _nurture(t):
    return D.nurture_due(t.deals, t.deal_tasks, t.organization_settings, "2024-02-20").select("id", "organization_id", "last_activity_at")


def _tasks_before(t):
    """Tasks before an edit: even ones did not exist yet, odd completed ones were pending."""
    rows = t.deal_tasks.filter(F.col("created_by_user_id").isNotNull())
    return rows.withColumn("status", F.when(F.col("completed_by_user_id").isNotNull(), "pending").otherwise(F.col("status")))


@query(
    "deals_task_activities",
    """WITH j AS (SELECT n.*, CASE WHEN n.created_by_user_id IS NOT NULL THEN CASE WHEN n.completed_by_user_id IS NOT NULL THEN 'pending' ELSE n.status END END AS o_status FROM deal_tasks n WHERE deal_id IS NOT NULL),
    u AS (SELECT DISTINCT user_id FROM members)
    SELECT deal_id, organization_id, 'task_created' AS activity_type, CASE WHEN u.user_id IS NULL THEN 'system' ELSE 'user' END AS actor, u.user_id AS actor_user_id, contact_id, FALSE AS bumps_last_activity, 'task_created:' || id AS source_event_key, created_at
      FROM j LEFT JOIN u ON u.user_id = created_by_user_id WHERE o_status IS NULL
    UNION ALL SELECT deal_id, organization_id, 'task_completed', 'user', u.user_id, contact_id, TRUE, 'task_completed:' || id, least(coalesce(completed_at, TIMESTAMP '2000-01-01'), TIMESTAMP '2000-01-01')
      FROM j LEFT JOIN u ON u.user_id = completed_by_user_id WHERE o_status IS NOT NULL AND status = 'completed' AND o_status <> 'completed'""",
)
def _task_activities(t):
    return D.task_activities(_tasks_before(t), t.deal_tasks, t.members, "2000-01-01").drop("title", "metadata")


@query(
    "deals_stamp_stage",
    f"""SELECT n.id, CASE WHEN o.id IS NOT NULL AND n.stage <> o.stage THEN TIMESTAMP '{AS_OF}' ELSE n.stage_updated_at END AS stage_updated_at,
      CASE WHEN o.id IS NOT NULL AND n.stage <> o.stage THEN CASE WHEN n.stage IN ('WON','LOST') THEN TIMESTAMP '{AS_OF}' END ELSE n.closed_at END AS closed_at
    FROM deals_after n LEFT JOIN deals o ON o.id = n.id AND o.organization_id = n.organization_id""",
)
def _stamp(t):
    return D.stamp_stage(t.deals, t.deals_after, AS_OF).select("id", "stage_updated_at", "closed_at")


@query(
    "deals_scope_violations",
    """SELECT e.source_event_key, e.contact_id, CASE WHEN d.id IS NULL THEN 'deal of another workspace' ELSE 'contact not linked' END AS violation
    FROM (SELECT *, 'dl' || substr(contact_id, 3) AS deal_id FROM contact_events) e LEFT JOIN deals d ON d.id = e.deal_id AND d.organization_id = e.organization_id
    WHERE d.id IS NULL OR NOT EXISTS (SELECT 1 FROM company_contacts l WHERE l.organization_id = e.organization_id AND l.company_id = d.company_id AND l.contact_id = e.contact_id)""",
)
def _violations(t):
    events = t.contact_events.withColumn("deal_id", F.concat(F.lit("dl"), F.substring("contact_id", 3, 20)))
    return D.scope_violations(t.deals, t.company_contacts, events).select("source_event_key", "contact_id", "violation")
