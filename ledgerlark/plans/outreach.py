"""Registered campaign and outreach queries and their oracles."""

from pyspark.sql import functions as F

from ledgerlark.operators import campaign as C
from ledgerlark.operators import outreach as O
from ledgerlark.plans.registry import query

_METRICS = """m AS (SELECT organization_id, campaign_id, count(*) FILTER (WHERE status IN ('sent','delivered','opened','clicked','replied')) AS emails_sent,
  count(*) FILTER (WHERE status IN ('delivered','opened','clicked','replied')) AS emails_delivered, count(opened_at) AS emails_opened, count(replied_at) AS emails_replied,
  count(*) FILTER (WHERE status = 'bounced') AS emails_bounced FROM campaign_emails WHERE campaign_id IS NOT NULL GROUP BY 1, 2),
 b AS (SELECT organization_id, campaign_id, count(*) AS n FROM campaign_activities WHERE activity_type = 'meeting_booked' GROUP BY 1, 2),
 k AS (SELECT m.*, coalesce(n, 0) AS meetings_booked FROM m LEFT JOIN b USING (organization_id, campaign_id))"""


@query("campaign_metrics", f"WITH {_METRICS} SELECT * FROM k")
def _metrics(t):
    return C.metrics(t.campaign_emails, t.campaign_activities)


def _rate(c: str, n: str) -> str:
    return f"CAST(coalesce(round(CAST({c} * 100 AS DECIMAL(30,10)) / nullif(emails_sent, 0), 2), 0) AS DECIMAL(12,2)) AS {n}"


@query("campaign_summary", f"WITH {_METRICS} SELECT *, {_rate('emails_opened', 'open_rate')}, {_rate('emails_replied', 'reply_rate')}, {_rate('meetings_booked', 'meeting_rate')} FROM k")
def _summary(t):
    return C.summary(C.metrics(t.campaign_emails, t.campaign_activities))


@query(
    "campaign_reach",
    """SELECT organization_id, campaign_id, count(DISTINCT contact_id) FILTER (WHERE status IN ('sent','delivered','opened','clicked','replied','bounced')) AS contacts_reached,
      count(DISTINCT contact_id) FILTER (WHERE status = 'replied') AS contacts_replied FROM campaign_emails WHERE campaign_id IS NOT NULL GROUP BY 1, 2""",
)
def _reach(t):
    return C.reach(t.campaign_emails)


@query(
    "campaign_totals",
    """SELECT organization_id, id AS campaign_id, (SELECT count(DISTINCT company_id) FROM campaign_companies x WHERE x.campaign_id = c.id AND x.organization_id = c.organization_id) AS total_companies,
      (SELECT count(*) FROM campaign_contacts x WHERE x.campaign_id = c.id AND x.organization_id = c.organization_id AND status = 'active') AS total_contacts FROM campaigns c""",
)
def _totals(t):
    return C.totals(t.campaigns, t.campaign_companies, t.campaign_contacts)


@query(
    "campaign_email_status_activities",
    """SELECT organization_id, contact_id, id AS campaign_email_id, CASE status WHEN 'replied' THEN 'email_received' ELSE 'email_sent' END AS activity_type,
      CASE status WHEN 'sent' THEN 'Campaign email sent' WHEN 'delivered' THEN 'Email delivered' WHEN 'opened' THEN 'Email opened' WHEN 'replied' THEN 'Received reply to campaign email' ELSE 'Email bounced' END AS title,
      CASE status WHEN 'sent' THEN coalesce('Email "' || subject || '" sent successfully', 'Campaign email sent') WHEN 'delivered' THEN coalesce('Email "' || subject || '" was delivered', 'Campaign email delivered')
        WHEN 'opened' THEN coalesce('Email "' || subject || '" was opened by recipient', 'Campaign email opened') WHEN 'replied' THEN coalesce('Reply received for email "' || subject || '"', 'Reply received to campaign email')
        ELSE coalesce('Email "' || subject || '" bounced', 'Campaign email bounced') END AS description,
      CAST(json_object('campaign_email_id', id, 'campaign_id', campaign_id, 'email_status', status, 'subject', subject, 'message_id', message_id, 'thread_id', thread_id) AS VARCHAR) AS metadata,
      CASE status WHEN 'sent' THEN sent_at WHEN 'delivered' THEN delivered_at WHEN 'opened' THEN opened_at WHEN 'replied' THEN replied_at ELSE bounced_at END AS occurred_at
    FROM email_status_changes WHERE status IN ('sent','delivered','opened','replied','bounced') AND old_status IS DISTINCT FROM status""",
)
def _activities(t):
    return C.email_status_activities(t.email_status_changes)


@query(
    "campaign_selected_companies",
    """SELECT id, array_to_string(list_transform(list_filter(from_json(curated_companies, '[{"id":"VARCHAR","selected":"BOOLEAN"}]'), lambda c: c.selected), lambda c: c.id), ',') AS selected_ids FROM campaigns""",
)
def _selected(t):
    return C.selected_companies(t.campaigns).select("id", F.array_join("selected_company_ids", ",").alias("selected_ids"))


@query(
    "campaign_select_all",
    """SELECT id, array_to_string(list_transform(from_json(curated_companies, '[{"id":"VARCHAR"}]'), lambda c: c.id), ',') AS selected_ids,
      len(from_json(curated_companies, '["JSON"]')) AS n FROM campaigns""",
)
def _select_all(t):
    marked = t.campaigns.withColumn("curated_companies", C.select_all_curated(F.col("curated_companies")))
    return C.selected_companies(marked).select("id", F.array_join("selected_company_ids", ",").alias("selected_ids"), F.json_array_length("curated_companies").cast("bigint").alias("n"))


@query(
    "campaign_link_contacts",
    """WITH named AS (SELECT organization_id, 'camp_' || CAST(CAST(substr(organization_id, 5) AS INT) AS VARCHAR) AS campaign_id, id AS contact_id, created_at FROM contacts WHERE skills IS NOT NULL
      UNION ALL SELECT organization_id, campaign_id, contact_id, created_at FROM campaign_emails WHERE campaign_id IS NOT NULL AND contact_id IS NOT NULL)
    SELECT organization_id, campaign_id, contact_id, min(created_at) AS added_at, 'manual' AS source_type, FALSE AS created_from_campaign, 'active' AS status FROM named n
    WHERE NOT EXISTS (SELECT 1 FROM campaign_contacts l WHERE l.organization_id = n.organization_id AND l.campaign_id = n.campaign_id AND l.contact_id = n.contact_id) GROUP BY 1, 2, 3""",
)
def _link(t):
    own = F.concat(F.lit("camp_"), F.substring("organization_id", 5, 9))
    return C.link_contacts(t.contacts.withColumn("campaign_id", F.when(F.col("skills").isNotNull(), own)), t.campaign_emails, t.campaign_contacts)


@query(
    "campaign_attribute_actions",
    """WITH f AS (SELECT t.organization_id, t.id, min(j.campaign_id) AS c FROM tasks t JOIN sequence_actions s ON s.review_task_id = t.id AND s.organization_id = t.organization_id
      JOIN campaign_contacts j ON j.id = s.campaign_contact_id AND j.organization_id = s.organization_id GROUP BY 1, 2)
    SELECT l.id, coalesce(l.campaign_id, f.c) AS campaign_id FROM linkedin_action_log l LEFT JOIN f ON f.organization_id = l.organization_id AND f.id = l.payload ->> '$.task_id'""",
)
def _attribute(t):
    return C.attribute_actions(t.linkedin_action_log, t.tasks, t.sequence_actions, t.campaign_contacts).select("id", "campaign_id")


@query(
    "campaign_company_status",
    """SELECT cc.id, CASE WHEN c.id IS NULL THEN cc.status WHEN c.processing_status = 'approved' THEN 'approved' WHEN c.processing_status = 'declined' THEN 'rejected' ELSE 'pending' END AS status
    FROM campaign_companies cc LEFT JOIN companies c ON c.id = cc.company_id AND c.organization_id = cc.organization_id""",
)
def _company_status(t):
    return C.company_status(t.campaign_companies, t.companies).select("id", "status")


@query(
    "campaign_for_contact",
    """SELECT l.organization_id, contact_id, campaign_id, c.name AS campaign_name, c.status AS campaign_status, added_at, source_type, l.status AS relationship_status
    FROM campaign_contacts l JOIN campaigns c ON c.id = l.campaign_id AND c.organization_id = l.organization_id""",
)
def _for_contact(t):
    return C.for_contact(t.campaign_contacts, t.campaigns)


@query(
    "campaign_contacts_of",
    """SELECT l.organization_id, campaign_id, contact_id, c.name AS contact_name, c.email AS contact_email, job_title, added_at, source_type, l.status AS relationship_status
    FROM campaign_contacts l JOIN contacts c ON c.id = l.contact_id AND c.organization_id = l.organization_id""",
)
def _contacts_of(t):
    return C.contacts_of(t.campaign_contacts, t.contacts)


@query(
    "campaign_normalize",
    """SELECT id, CASE WHEN status IN ('active','paused','completed','cancelled') OR (status = 'draft' AND json_array_length(metadata -> '$.completed_steps') = 5) THEN TRUE ELSE wizard_completed END AS wizard_completed,
      CASE WHEN started_at IS NULL AND status IN ('active','paused','completed') THEN coalesce(TRY_CAST(metadata ->> '$.launched_at' AS TIMESTAMP), created_at) ELSE started_at END AS started_at,
      coalesce(emails_sent, 0) AS emails_sent, CASE WHEN metadata IS NULL THEN '{}' WHEN metadata ->> '$.launched_at' IS NOT NULL THEN '{"n":1}' ELSE metadata END AS metadata FROM campaigns""",
)
def _normalize(t):
    return C.normalize(t.campaigns).select("id", "wizard_completed", "started_at", "emails_sent", "metadata")


# ---------------------------------------------------------------- follow-up

_DRAFTS = """d AS (SELECT organization_id, campaign_id, contact_id, count(*) FILTER (WHERE status = 'completed' AND sent_at IS NOT NULL) AS sent_email_count,
  count(*) FILTER (WHERE status IN ('pending','in_review')) AS pending_tasks, count(*) FILTER (WHERE status IN ('rejected','cancelled')) AS declined_tasks, count(*) AS total_tasks, max(sent_at) AS last_sent_at
  FROM tasks WHERE task_type = 'review_draft' GROUP BY 1, 2, 3)"""
_HOURS = "CAST(round((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(last_sent_at)) / 3600000000, 1) AS DECIMAL(20,1)) AS hours_since_last_email"


def _eligible_sql(hours: int) -> str:
    return f"""WITH {_DRAFTS}
    SELECT d.organization_id, m.name AS campaign_name, c.name AS contact_name, c.email AS contact_email, last_thread_id, last_incoming_email_at, f.name AS company_name, d.campaign_id, d.contact_id, l.company_id,
      sent_email_count, sent_email_count + 1 AS next_sequence_number, pending_tasks, declined_tasks, total_tasks, last_sent_at, {_HOURS}
    FROM d JOIN campaigns m ON m.id = d.campaign_id AND m.organization_id = d.organization_id JOIN contacts c ON c.id = d.contact_id AND c.organization_id = d.organization_id
      LEFT JOIN (SELECT DISTINCT organization_id, contact_id, company_id FROM company_contacts) l ON l.contact_id = d.contact_id AND l.organization_id = d.organization_id
      LEFT JOIN companies f ON f.id = l.company_id AND f.organization_id = l.organization_id
    WHERE m.status = 'active' AND c.pipeline_stage = 'PROSPECT' AND c.unsubscribed_at IS NULL AND stop_drafts IS NOT TRUE AND do_not_contact IS NOT TRUE AND last_thread_id <> ''
      AND sent_email_count BETWEEN 1 AND 4 AND pending_tasks = 0 AND declined_tasks = 0 AND last_sent_at < TIMESTAMP '2002-01-01' - INTERVAL {hours} HOUR
      AND (last_incoming_email_at IS NULL OR last_incoming_email_at <= last_sent_at)"""


@query("outreach_followup_eligible", _eligible_sql(96))
def _eligible(t):
    return O.followup_eligible(t.tasks, t.contacts, t.campaigns, t.company_contacts, t.companies, "2002-01-01")


@query("outreach_followup_eligible_30h", _eligible_sql(30))
def _eligible_30(t):
    return O.followup_eligible(t.tasks, t.contacts, t.campaigns, t.company_contacts, t.companies, "2002-01-01", min_hours=30)


def _chk(name: str, cond: str, why: str) -> str:
    return f"CASE WHEN {cond} THEN 'ok' ELSE '{why}' END AS chk_{name}"


@query(
    "outreach_followup_diagnostics",
    f"""WITH {_DRAFTS}
    SELECT d.organization_id, d.campaign_id, d.contact_id, m.name AS campaign_name, m.status AS campaign_status, c.name AS contact_name, pipeline_stage, sent_email_count, pending_tasks, declined_tasks, last_sent_at, {_HOURS},
      {_chk('campaign_active', "m.status = 'active'", 'campaign not active')}, {_chk('prospect', "pipeline_stage = 'PROSPECT'", 'not PROSPECT')}, {_chk('unsubscribed', 'unsubscribed_at IS NULL', 'unsubscribed')},
      {_chk('stop_drafts', 'stop_drafts IS NOT TRUE', 'stop_drafts=true')}, {_chk('do_not_contact', 'do_not_contact IS NOT TRUE', 'do_not_contact')}, {_chk('has_thread', "last_thread_id <> ''", 'no thread id')},
      {_chk('has_sent', 'sent_email_count > 0', 'no emails sent')}, {_chk('under_max', 'sent_email_count < 5', 'max emails reached')}, {_chk('no_pending', 'pending_tasks = 0', 'has pending tasks')},
      {_chk('no_declined', 'declined_tasks = 0', 'has declined tasks')}, {_chk('time_elapsed', "last_sent_at < TIMESTAMP '2002-01-01' - INTERVAL 96 HOUR", 'too recent (<96h)')},
      {_chk('no_reply', 'last_incoming_email_at IS NULL OR last_incoming_email_at <= last_sent_at', 'contact replied')}
    FROM d JOIN campaigns m ON m.id = d.campaign_id AND m.organization_id = d.organization_id LEFT JOIN contacts c ON c.id = d.contact_id AND c.organization_id = d.organization_id""",
)
def _diagnostics(t):
    return O.followup_diagnostics(t.tasks, t.contacts, t.campaigns, "2002-01-01")


@query(
    "outreach_due_actions",
    """SELECT id, campaign_contact_id, channel, action_type, 'claimed' AS status, scheduled_at, TIMESTAMP '1999-01-01 00:05:00' AS lease_expires_at, coalesce(attempts, 0) + 1 AS attempts FROM sequence_actions
    WHERE (status = 'pending' AND (scheduled_at IS NULL OR scheduled_at <= TIMESTAMP '1999-01-01') AND (retry_at IS NULL OR retry_at <= TIMESTAMP '1999-01-01')) OR (status = 'claimed' AND lease_expires_at < TIMESTAMP '1999-01-01')
    ORDER BY scheduled_at NULLS FIRST, id LIMIT 100""",
)
def _due_actions(t):
    return O.due_actions(t.sequence_actions, "1999-01-01", "1999-01-01 00:05:00", 100).select(
        "id", "campaign_contact_id", "channel", "action_type", "status", "scheduled_at", "lease_expires_at", "attempts"
    )


@query(
    "outreach_due_manual_tasks",
    """SELECT id, due_date, 'token-1' AS token FROM tasks WHERE task_type = 'manual_outreach' AND status = 'pending' AND due_date <= TIMESTAMP '2002-01-05' AND coalesce(trim(body), '') = ''
      AND (coalesce(metadata ->> '$.copy_claimed_at', '') = '' OR CAST(metadata ->> '$.copy_claimed_at' AS TIMESTAMP) < TIMESTAMP '2002-01-05' - INTERVAL 15 MINUTE) ORDER BY due_date, created_at, id LIMIT 5000""",
)
def _due_manual(t):
    rows = O.due_manual_tasks(t.tasks, "2002-01-05", 5000, "token-1")
    return rows.select("id", "due_date", F.get_json_object("metadata", "$.copy_claim_token").alias("token"))


@query(
    "outreach_due_journeys",
    "SELECT * FROM campaign_contacts WHERE next_action_at <= TIMESTAMP '2024-01-20' AND journey_state NOT IN ('replied','declined','failed','completed','cancelled')",
)
def _due_journeys(t):
    return O.due_journeys(t.campaign_contacts, "2024-01-20")


# ---------------------------------------------------------------- company matching


def _firms(t):
    """Companies with the outreach columns, their domain read from the website."""
    from ledgerlark.functions.text import non_empty, website_domain

    return t.companies.withColumns(
        {
            "domain": website_domain(non_empty(F.col("website"))),
            "first_outreach_date": F.when(F.col("used_for_outreach"), F.col("created_at")),
            "last_outreach_date": F.lit(None).cast("timestamp"),
            "outreach_campaigns": F.when(F.col("outreach_count") > 0, F.array(F.lit("Spring"))),
        }
    )


_FIRMS = """f AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(nullif(website, ''), '^https?://', ''), '^www\\.', ''), '/.*$', '') AS domain FROM companies),
 best AS (SELECT organization_id, candidate_id, min_by(cid, (r, cid)) AS company_id FROM (
    SELECT c.organization_id, candidate_id, f.id AS cid, 1 AS r FROM outreach_candidates c JOIN f ON f.organization_id = c.organization_id AND c.profile_url <> '' AND f.profile_url = c.profile_url
    UNION ALL SELECT c.organization_id, candidate_id, f.id, 2 FROM outreach_candidates c JOIN f ON f.organization_id = c.organization_id AND c.name <> '' AND lower(f.name) = lower(c.name)
    UNION ALL SELECT c.organization_id, candidate_id, f.id, 3 FROM outreach_candidates c JOIN f ON f.organization_id = c.organization_id AND c.domain <> '' AND f.domain = c.domain) GROUP BY 1, 2),
 matched AS (SELECT c.*, company_id FROM outreach_candidates c LEFT JOIN best USING (organization_id, candidate_id))"""


@query(
    "outreach_filter_companies",
    f"WITH {_FIRMS} SELECT m.organization_id, candidate_id, m.profile_url, m.name, m.domain, company_id, coalesce(used_for_outreach, FALSE) AS is_already_used FROM matched m LEFT JOIN f ON f.id = m.company_id AND f.organization_id = m.organization_id",
)
def _filter_companies(t):
    return O.filter_companies(_firms(t), t.outreach_candidates)


# candidates one after the other: who has none of the keys taken so far makes a company
_MARKED = f"""WITH RECURSIVE {_FIRMS},
    asked AS (SELECT organization_id, candidate_id, company_id, list_filter(['u:' || nullif(profile_url, ''), 'n:' || lower(nullif(name, '')), 'd:' || nullif(domain, '')], lambda k: k IS NOT NULL) AS ks FROM matched),
    queue AS (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY candidate_id) AS i FROM asked WHERE company_id IS NULL),
    walk AS (SELECT DISTINCT organization_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS maker, CAST([] AS VARCHAR[]) AS mk FROM queue
      UNION ALL SELECT q.organization_id, q.i, CASE WHEN list_has_any(taken, ks) THEN taken ELSE list_concat(taken, ks) END, CASE WHEN NOT list_has_any(taken, ks) THEN candidate_id END, ks
      FROM walk w JOIN queue q ON q.organization_id = w.organization_id AND q.i = w.i + 1),
    offered AS (SELECT organization_id, maker, unnest(mk) AS k FROM walk WHERE maker IS NOT NULL),
    options AS (
      SELECT c.organization_id, candidate_id, 'new:' || maker AS cid, strpos('und', k[1]) AS r FROM (SELECT organization_id, candidate_id, unnest(ks) AS k FROM asked) c JOIN offered USING (organization_id, k) WHERE maker <= candidate_id
      UNION ALL SELECT c.organization_id, candidate_id, f.id, 1 FROM outreach_candidates c JOIN f ON f.organization_id = c.organization_id AND c.profile_url <> '' AND f.profile_url = c.profile_url
      UNION ALL SELECT c.organization_id, candidate_id, f.id, 2 FROM outreach_candidates c JOIN f ON f.organization_id = c.organization_id AND c.name <> '' AND lower(f.name) = lower(c.name)
      UNION ALL SELECT c.organization_id, candidate_id, f.id, 3 FROM outreach_candidates c JOIN f ON f.organization_id = c.organization_id AND c.domain <> '' AND f.domain = c.domain
      UNION ALL SELECT organization_id, maker, 'new:' || maker, 9 FROM walk WHERE maker IS NOT NULL),
    final AS (SELECT organization_id, candidate_id, min_by(cid, (r, cid)) AS company_id FROM options GROUP BY 1, 2)"""


@query(
    "outreach_mark_companies",
    f"""{_MARKED}, hits AS (SELECT organization_id, company_id AS id, count(*) AS n FROM final GROUP BY 1, 2)
    SELECT f.id, f.organization_id, CASE WHEN n IS NOT NULL THEN TRUE ELSE used_for_outreach END AS used_for_outreach, CAST(outreach_count + coalesce(n, 0) AS INT) AS outreach_count,
      CASE WHEN n IS NULL THEN CASE WHEN outreach_count > 0 THEN 'Spring' END WHEN outreach_count > 0 THEN 'Spring,Autumn' ELSE 'Autumn' END AS campaigns
    FROM f LEFT JOIN hits USING (organization_id, id)
    UNION ALL SELECT id, organization_id, TRUE, CAST(n AS INT), 'Autumn' FROM hits WHERE id LIKE 'new:%'""",
)
def _mark(t):
    companies, _ = O.mark_companies(_firms(t), t.outreach_candidates, "Autumn", "2024-06-01")
    return companies.select("id", "organization_id", "used_for_outreach", "outreach_count", F.array_join("outreach_campaigns", ",").alias("campaigns"))


@query(
    "outreach_mark_results",
    f"""{_MARKED} SELECT x.organization_id, x.candidate_id, x.company_id,
      coalesce(used_for_outreach, FALSE) OR row_number() OVER (PARTITION BY x.organization_id, x.company_id ORDER BY x.candidate_id) > 1 AS was_already_used
    FROM final x LEFT JOIN f ON f.id = x.company_id AND f.organization_id = x.organization_id""",
)
def _mark_results(t):
    return O.mark_companies(_firms(t), t.outreach_candidates, "Autumn", "2024-06-01")[1].drop("marked_successfully")


@query("outreach_unused_companies", "SELECT id, organization_id, created_at FROM companies WHERE used_for_outreach IS NOT TRUE ORDER BY created_at DESC, id LIMIT 100")
def _unused(t):
    return O.unused_companies(t.companies, 100).select("id", "organization_id", "created_at")


@query("outreach_exclude_competitors", "SELECT id, organization_id, name FROM companies WHERE is_competitor IS NOT TRUE")
def _competitors(t):
    return O.exclude_competitors(t.companies).select("id", "organization_id", "name")


@query(
    "outreach_exclude_suppressed",
    """SELECT id, organization_id, email FROM contacts c WHERE NOT EXISTS (SELECT 1 FROM suppressions s WHERE s.scope = 'onboarding_lifecycle' AND lower(trim(s.email)) = lower(trim(c.email))
      AND (s.organization_id IS NULL OR s.organization_id = c.organization_id))""",
)
def _suppressed(t):
    return O.exclude_suppressed(t.contacts, t.suppressions, "onboarding_lifecycle").select("id", "organization_id", "email")


@query(
    "outreach_reply_autosend_gate",
    """SELECT r.*, CASE WHEN (CASE WHEN channel = 'linkedin' THEN autosend_linkedin ELSE autosend_email END) IS NOT TRUE THEN 'channel off'
      WHEN list_contains(string_split(autosend_intents_text, ','), intent) IS NOT TRUE THEN 'intent not allowed' WHEN (confidence >= autosend_min_confidence) IS NOT TRUE THEN 'confidence too low' ELSE 'send' END AS gate
    FROM reply_drafts r LEFT JOIN campaigns c ON c.id = r.campaign_id AND c.organization_id = r.organization_id""",
)
def _gate(t):
    return O.reply_autosend_gate(t.reply_drafts, t.campaigns.withColumn("autosend_intents", F.split("autosend_intents_text", ",")))
