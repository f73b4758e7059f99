"""Registered identity and task clean-up queries and their oracles."""

from pyspark.sql import functions as F

from ledgerlark.operators import identity as I
from ledgerlark.operators import tasks as K
from ledgerlark.plans.registry import query

_URL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(profile_url)), '^https?://', ''), '^//', ''), '^([a-z0-9-]+\.)?linkedin\.com', 'linkedin.com'), '[?#].*$', ''), '/+$', '')"""
_KEYS = f"""k AS (SELECT *, CASE WHEN regexp_matches({_URL}, '^linkedin\\.com/(in|company)/[a-z0-9_\\-%.]+') THEN {_URL} END AS url_key, lower(nullif(email, '')) AS email_key FROM contacts)"""


@query("identity_keys", f"WITH {_KEYS} SELECT id, url_key, email_key FROM k")
def _keys(t):
    return I.with_keys(t.contacts).select("id", "url_key", "email_key")


def _dup(key: str) -> str:
    return f"""WITH {_KEYS}, g AS (SELECT organization_id, {key} AS dup_key, count(*) AS dup_count, min_by(id, (created_at, id)) AS first_contact_id FROM k WHERE {key} IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT k.organization_id, dup_key, k.id AS contact_id, created_at, dup_count, first_contact_id FROM g JOIN k ON k.organization_id = g.organization_id AND k.{key} = dup_key"""


@query("identity_duplicates_by_url", _dup("url_key"))
def _dup_url(t):
    return I.duplicate_contacts(t.contacts, "url_key")


@query("identity_duplicates_by_email", _dup("email_key"))
def _dup_email(t):
    return I.duplicate_contacts(t.contacts, "email_key")


_RICH = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in I.RICHNESS_COLUMNS)


@query(
    "identity_soft_merge",
    f"""WITH {_KEYS}, r AS (SELECT organization_id AS o, id, url_key, email_key, created_at, {_RICH} AS rich FROM k),
    u AS (SELECT *, CASE WHEN url_key IS NULL THEN id ELSE first_value(id) OVER (PARTITION BY o, url_key ORDER BY rich DESC, created_at, id) END AS url_owner FROM r),
    h AS (SELECT *, CASE WHEN email_key IS NULL THEN id ELSE first_value(id) OVER (PARTITION BY o, email_key ORDER BY rich DESC, created_at, id) END AS owner FROM u WHERE url_owner = id)
    SELECT u.o AS organization_id, u.id, CASE WHEN h.owner <> u.id THEN h.owner END AS canonical_contact_id FROM u JOIN h ON h.o = u.o AND h.id = u.url_owner""",
)
def _merge(t):
    return I.soft_merge(t.contacts)


_GHOST = "coalesce(trim(first_name), '') = '' AND coalesce(trim(last_name), '') = '' AND coalesce(trim(email), '') = '' AND coalesce(trim(profile_url), '') = ''"


@query("identity_flag_phantoms", f"SELECT id, CASE WHEN {_GHOST} THEN 'phantom_pending_rediscovery' ELSE processing_status END AS processing_status FROM contacts")
def _phantoms(t):
    return I.flag_phantoms(t.contacts).select("id", "processing_status")


@query("identity_phantom_backup", f"SELECT id, organization_id, processing_status FROM contacts WHERE {_GHOST}")
def _phantom_backup(t):
    return I.phantom_backup(t.contacts).select("id", "organization_id", "processing_status")


@query(
    "identity_phantom_link_backup",
    f"SELECT l.id, l.contact_id, l.company_id, l.organization_id FROM company_contacts l JOIN contacts c ON c.id = l.contact_id AND c.organization_id = l.organization_id WHERE {_GHOST}",
)
def _phantom_links(t):
    return I.phantom_link_backup(t.company_contacts, t.contacts).drop("relationship_snapshot")


@query(
    "crm_link_raw_records",
    """SELECT r.id, r.organization_id, raw_name, coalesce(u.company_id, extracted_company_id) AS extracted_company_id, coalesce(u.person_id, extracted_person_id) AS extracted_person_id
    FROM crm_raw_records r LEFT JOIN raw_updates u ON u.record_id = r.id AND u.organization_id = r.organization_id""",
)
def _raw(t):
    return I.link_raw_records(t.crm_raw_records, t.raw_updates)


@query(
    "crm_list_members",
    "SELECT organization_id, list_id, company_id, contact_id, min(created_at) AS created_at FROM crm_list_members WHERE (company_id IS NULL) <> (contact_id IS NULL) GROUP BY 1, 2, 3, 4",
)
def _members(t):
    return I.list_members(t.crm_list_members)[0]


@query("crm_list_members_rejected", "SELECT * FROM crm_list_members WHERE (company_id IS NULL) = (contact_id IS NULL)")
def _rejected(t):
    return I.list_members(t.crm_list_members)[1]


@query(
    "tasks_cancel_duplicates",
    """WITH d AS (SELECT id, row_number() OVER (PARTITION BY contact_id, organization_id ORDER BY created_at, id) AS rn FROM tasks
      WHERE task_type = 'review_draft' AND status = 'pending' AND thread_id IS NULL AND (metadata ->> '$.channel') IS DISTINCT FROM 'linkedin')
    SELECT t.id, CASE WHEN rn > 1 THEN 'cancelled' ELSE status END AS status, CASE WHEN rn > 1 THEN 'duplicate_first_email_cleanup' END AS reason FROM tasks t LEFT JOIN d USING (id)""",
)
def _cancel(t):
    return K.cancel_duplicates(t.tasks).select("id", "status", F.get_json_object("metadata", "$.cancelled_reason").alias("reason"))


_PENDING = """p AS (SELECT * FROM tasks WHERE task_type = 'review_draft' AND status = 'pending' AND contact_id IS NOT NULL),
 g AS (SELECT organization_id, contact_id, count(*) AS total_tasks, min(created_at) AS oldest FROM p GROUP BY 1, 2 HAVING count(*) > 1)"""


@query(
    "tasks_duplicate_report",
    f"""WITH {_PENDING} SELECT organization_id, contact_id, total_tasks, count(*) FILTER (WHERE created_at = oldest) AS will_keep, count(*) FILTER (WHERE created_at IS DISTINCT FROM oldest) AS will_cancel
    FROM p JOIN g USING (organization_id, contact_id) GROUP BY 1, 2, 3""",
)
def _report(t):
    return K.duplicate_report(t.tasks)


@query(
    "tasks_duplicate_detail",
    f"""WITH {_PENDING} SELECT p.organization_id, p.id AS task_id, p.contact_id, c.name AS contact_name, c.email AS contact_email, p.created_at,
      CAST(epoch(p.created_at) AS BIGINT) - CAST(epoch(oldest) AS BIGINT) AS seconds_after_first
    FROM p JOIN g USING (organization_id, contact_id) LEFT JOIN contacts c ON c.id = p.contact_id AND c.organization_id = p.organization_id WHERE p.created_at IS DISTINCT FROM oldest""",
)
def _detail(t):
    return K.duplicate_detail(t.tasks, t.contacts)


@query(
    "tasks_cancel_duplicate_processing",
    """WITH o AS (SELECT organization_id, contact_id, min(created_at) AS oldest FROM tasks WHERE task_type = 'email_generation_processing' AND status IN ('pending','in_progress') AND contact_id IS NOT NULL GROUP BY 1, 2)
    SELECT t.id, CASE WHEN task_type = 'email_generation_processing' AND status IN ('pending','in_progress') AND t.created_at > oldest THEN 'cancelled' ELSE status END AS status FROM tasks t LEFT JOIN o USING (organization_id, contact_id)""",
)
def _locks(t):
    return K.cancel_duplicate_processing(t.tasks).select("id", "status")


@query(
    "tasks_cancel_stuck",
    """SELECT id, CASE WHEN s THEN 'cancelled' ELSE status END AS status, CASE WHEN s THEN 'stuck processing task' END AS reason FROM
      (SELECT *, coalesce(task_type = 'email_generation_processing' AND status = 'pending' AND created_at < TIMESTAMP '1999-01-01' - INTERVAL 10 MINUTE, FALSE) AS s FROM tasks)""",
)
def _stuck(t):
    return K.cancel_stuck(t.tasks, "1999-01-01").select("id", "status", F.get_json_object("metadata", "$.cleanup_reason").alias("reason"))


def _with_copy(t):
    return t.tasks.withColumns(
        {
            "email_copy": F.when(F.col("completed_at").isNotNull(), F.concat(F.lit("Old "), "id")),
            "edited_copy": F.when(F.col("due_date").isNull(), F.when(F.col("email_id").isNull(), "").otherwise(F.concat(F.lit("Edited "), "id"))),
            "subject": F.when(F.col("channel") == "email", "").when(F.col("channel") == "manual", F.lit("Set")),
            "scheduled_date": F.col("due_date"),
        }
    )


_COPY = """w AS (SELECT *, CASE WHEN completed_at IS NOT NULL THEN 'Old ' || id END AS email_copy, CASE WHEN due_date IS NULL THEN CASE WHEN email_id IS NULL THEN '' ELSE 'Edited ' || id END END AS edited_copy,
  CASE channel WHEN 'email' THEN '' WHEN 'manual' THEN 'Set' END AS subject FROM tasks)"""


@query(
    "tasks_consolidate",
    f"""WITH {_COPY},
    fresh AS (SELECT d.*, CASE d.status WHEN 'sent' THEN 'completed' WHEN 'approved' THEN 'completed' WHEN 'rejected' THEN 'rejected' WHEN 'in_review' THEN 'in_review' ELSE 'pending' END AS new_status FROM email_copy_drafts d
      WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.id = d.id AND t.organization_id = d.organization_id) AND EXISTS (SELECT 1 FROM contacts c WHERE c.id = d.contact_id AND c.organization_id = d.organization_id)
        AND (company_id IS NULL OR EXISTS (SELECT 1 FROM companies c WHERE c.id = d.company_id AND c.organization_id = d.organization_id))
        AND (campaign_id IS NULL OR EXISTS (SELECT 1 FROM campaigns c WHERE c.id = d.campaign_id AND c.organization_id = d.organization_id)))
    SELECT id, task_type, status, CASE WHEN task_type = 'review_draft' THEN coalesce(body, email_copy) ELSE body END AS body, CASE WHEN task_type = 'review_draft' THEN coalesce(email_copy, body) ELSE email_copy END AS email_copy, subject FROM w
    UNION ALL SELECT id, 'review_draft', new_status, body, body, subject FROM fresh""",
)
def _consolidate(t):
    out = K.consolidate(t.email_copy_drafts, _with_copy(t), t.contacts, t.companies, t.campaigns)
    return out.select("id", "task_type", "status", "body", "email_copy", "subject")


@query(
    "tasks_fill_email_fields",
    f"""WITH {_COPY}, c AS (SELECT *, coalesce(nullif(edited_copy, ''), email_copy) AS copy FROM w)
    SELECT id, copy AS email_copy, coalesce(nullif(subject, ''), nullif(metadata ->> '$.subject', ''), subject) AS subject, coalesce(nullif(body, ''), nullif(copy, ''), body) AS body,
      CASE WHEN status = 'completed' AND sent_at IS NOT NULL AND (send_status IS NULL OR send_status = 'not_sent') THEN 'sent_success' ELSE send_status END AS send_status,
      CASE WHEN created_by_user_id IS NULL AND task_type = 'review_draft' THEN 'api' ELSE created_by_user_id END AS created_by_user_id,
      CASE WHEN task_type = 'meeting' AND due_date IS NOT NULL THEN strftime(due_date, '%Y-%m-%d %H:%M:%S') END AS meeting_date FROM c""",
)
def _fill(t):
    return K.fill_email_fields(_with_copy(t)).select(
        "id", "email_copy", "subject", "body", "send_status", "created_by_user_id", F.get_json_object("metadata", "$.meeting_details.scheduled_date").alias("meeting_date")
    )
