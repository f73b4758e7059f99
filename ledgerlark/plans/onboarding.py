"""Registered onboarding, event and inbox queries and their oracles."""


from ledgerlark.operators import inbox as X
from ledgerlark.operators import onboarding as N
from ledgerlark.plans.registry import query

AS_OF = "2024-01-31 00:00:00"


@query(
    "onboarding_dropouts",
    """WITH e AS (SELECT organization_id, max_by(user_id, (occurred_at, user_id)) AS user_id, max_by(user_email, (occurred_at, user_id)) AS user_email, max(occurred_at) AS at_ FROM onboarding_events WHERE to_status = 'researched' GROUP BY 1)
    SELECT e.organization_id, onboarding_status, user_id, user_email, at_ AS entered_status_at, company_website FROM e JOIN workspaces w ON w.id = e.organization_id
    WHERE at_ <= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR AND NOT EXISTS (SELECT 1 FROM reengagement_sends s WHERE s.organization_id = e.organization_id AND s.sequence_step = 'step_1')
      AND NOT EXISTS (SELECT 1 FROM onboarding_events p WHERE p.organization_id = e.organization_id AND p.to_status IN ('launched','approved') AND p.occurred_at > at_)""",
)
def _dropouts(t):
    return N.dropouts(t.onboarding_events, t.workspaces, t.reengagement_sends, "researched", ["launched", "approved"], 24, "step_1", AS_OF)


STEPS = [
    N.SequenceStep("step_0", delay_hours=24),
    N.SequenceStep("step_1", from_status="researched", excluded=("approved", "launched"), delay_hours=12, audience_mode="funnel_stage"),
    N.SequenceStep("step_2", delay_hours=500),
    N.SequenceStep("step_3", is_active=False),
]


@query(
    "onboarding_sequence_audience",
    """WITH l AS (SELECT organization_id, max(occurred_at) FILTER (WHERE to_status = 'researched') AS e, max(occurred_at) FILTER (WHERE to_status IN ('approved','launched')) AS p FROM onboarding_events GROUP BY 1),
    a AS (SELECT id AS organization_id, 'step_0' AS sequence_step FROM workspaces WHERE NOT deleted AND activated_at IS NULL AND NOT card_on_file AND created_at <= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR
      UNION ALL SELECT id, 'step_2' FROM workspaces WHERE NOT deleted AND activated_at IS NULL AND NOT card_on_file AND created_at <= TIMESTAMP '2024-01-31' - INTERVAL 500 HOUR
      UNION ALL SELECT id, 'step_1' FROM workspaces JOIN l ON l.organization_id = id WHERE NOT deleted AND e <= TIMESTAMP '2024-01-31' - INTERVAL 12 HOUR AND (p IS NULL OR p <= e))
    SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM reengagement_sends s WHERE s.organization_id = a.organization_id AND s.sequence_step = a.sequence_step)""",
)
def _audience(t):
    return N.sequence_audience(STEPS, t.onboarding_events, t.workspaces, t.reengagement_sends, AS_OF)


@query(
    "onboarding_funnel",
    """SELECT to_status, count(DISTINCT organization_id) AS workspaces, CAST(round(CAST(count(DISTINCT organization_id) * 100 AS DECIMAL(30,10)) / (SELECT count(DISTINCT organization_id) FROM onboarding_events), 2) AS DECIMAL(12,2)) AS share
    FROM onboarding_events GROUP BY 1""",
)
def _funnel(t):
    return N.funnel(t.onboarding_events)


@query(
    "onboarding_transitions",
    """WITH f AS (SELECT organization_id, to_status, min(occurred_at) AS at_ FROM onboarding_events GROUP BY 1, 2),
    m AS (SELECT to_status, lag(to_status) OVER w AS from_status, CAST(floor(epoch(at_)) AS BIGINT) - CAST(floor(epoch(lag(at_) OVER w)) AS BIGINT) AS s FROM f WINDOW w AS (PARTITION BY organization_id ORDER BY at_, to_status))
    SELECT from_status, to_status, count(*) AS moves, CAST(sum(s) AS BIGINT) AS total_seconds, quantile_disc(s, 0.5) AS median_seconds FROM m WHERE from_status IS NOT NULL GROUP BY 1, 2""",
)
def _transitions(t):
    return N.transitions(t.onboarding_events)


@query(
    "onboarding_current_status",
    "SELECT organization_id, max_by(to_status, (occurred_at, id)) AS status, max(occurred_at) AS since FROM onboarding_events GROUP BY 1",
)
def _status(t):
    return N.current_status(t.onboarding_events)


def _rate(c, n):
    return f"CAST(round(CAST({c} * 100 AS DECIMAL(30,10)) / sends, 2) AS DECIMAL(12,2)) AS {n}"


@query(
    "onboarding_reengagement_rates",
    f"""WITH c AS (SELECT sequence_step, count(*) AS sends, count(opened_at) AS opened, count(clicked_at) AS clicked, count(converted_at) AS converted FROM reengagement_sends GROUP BY 1)
    SELECT *, {_rate('opened', 'open_rate')}, {_rate('clicked', 'click_rate')}, {_rate('converted', 'conversion_rate')} FROM c""",
)
def _rates(t):
    return N.reengagement_rates(t.reengagement_sends)


@query(
    "broadcast_progress",
    """SELECT b.id, title, count(s.id) AS recipient_count, count(*) FILTER (WHERE status = 'pending') AS pending_count, count(*) FILTER (WHERE status = 'sent') AS sent_count,
      count(*) FILTER (WHERE status = 'failed') AS failed_count, count(*) FILTER (WHERE status = 'suppressed') AS suppressed_count FROM broadcasts b LEFT JOIN broadcast_sends s ON s.broadcast_id = b.id GROUP BY 1, 2""",
)
def _broadcast(t):
    return N.broadcast_progress(t.broadcasts, t.broadcast_sends)


_REGS = """r AS (SELECT event_id, lower(trim(email)) AS email, id, organization_id, status, registered_at FROM event_registrations QUALIFY row_number() OVER (PARTITION BY event_id, lower(trim(email)) ORDER BY registered_at DESC, id DESC) = 1),
p AS (SELECT organization_id, lower(trim(email)) AS email, min(id) AS contact_id FROM contacts WHERE email IS NOT NULL GROUP BY 1, 2),
g AS (SELECT r.*, contact_id FROM r JOIN event_pages v ON v.id = r.event_id LEFT JOIN p ON p.organization_id = r.organization_id AND p.email = r.email)"""


@query("events_registrations", f"WITH {_REGS} SELECT * FROM g")
def _registrations(t):
    return N.registrations(t.event_pages, t.event_registrations, t.contacts)


@query(
    "events_registration_counts",
    f"""WITH {_REGS}, c AS (SELECT event_id, count(*) FILTER (WHERE status = 'registered') AS registered, count(*) FILTER (WHERE status = 'attended') AS attended, count(*) FILTER (WHERE status = 'cancelled') AS cancelled, count(contact_id) AS known_contacts FROM g GROUP BY 1)
    SELECT v.id, v.organization_id, title, capacity, coalesce(registered, 0) AS registered, coalesce(attended, 0) AS attended, coalesce(cancelled, 0) AS cancelled, coalesce(known_contacts, 0) AS known_contacts,
      CASE WHEN capacity IS NOT NULL THEN greatest(capacity - coalesce(registered, 0) - coalesce(attended, 0), 0) END AS seats_left, coalesce(coalesce(registered, 0) + coalesce(attended, 0) >= capacity, FALSE) AS is_full
    FROM event_pages v LEFT JOIN c ON c.event_id = v.id""",
)
def _counts(t):
    return N.registration_counts(t.event_pages, N.registrations(t.event_pages, t.event_registrations, t.contacts))


# ---------------------------------------------------------------- inbox


@query(
    "inbox_visible_threads",
    "SELECT * FROM linkedin_threads WHERE thread_status = 'active' AND thread_origin IN ('outbound', 'campaign_inbound') ORDER BY last_message_at DESC, id LIMIT 10",
)
def _visible(t):
    return X.visible_threads(t.linkedin_threads, 10)


@query("inbox_tag_thread_origin", "SELECT id, coalesce(thread_origin, CASE WHEN contact_id IS NULL THEN 'unrelated_inbound' ELSE 'campaign_inbound' END) AS thread_origin FROM linkedin_threads")
def _tag(t):
    return X.tag_thread_origin(t.linkedin_threads).select("id", "thread_origin")


THREADS = """WITH h AS (SELECT organization_id, chat_id, max(sent_at) FILTER (WHERE direction = 'outbound') AS last_outbound_at, max(sent_at) AS last_message_at, max_by(substr(body, 1, 200), (sent_at, id)) AS last_message_preview,
  max_by(direction, (sent_at, id)) AS last_direction FROM linkedin_messages GROUP BY 1, 2)
SELECT h.*, (SELECT count(*) FROM linkedin_messages m WHERE m.organization_id = h.organization_id AND m.chat_id = h.chat_id AND direction = 'inbound' AND (last_outbound_at IS NULL OR sent_at > last_outbound_at)) AS unread_count FROM h"""


@query("inbox_thread_summary", THREADS)
def _threads(t):
    return X.thread_summary(t.linkedin_messages)


@query(
    "inbox_unmatched_queue",
    """WITH o AS (SELECT * FROM unmatched_replies QUALIFY row_number() OVER (PARTITION BY coalesce(email_id, 'row:' || id) ORDER BY received_at, id) = 1)
    SELECT organization_id, resolution_status, count(*) AS replies, min(received_at) AS oldest_received_at FROM o GROUP BY 1, 2""",
)
def _unmatched(t):
    return X.unmatched_queue(t.unmatched_replies)


@query(
    "events_retention",
    """SELECT * REPLACE (CASE WHEN received_at < TIMESTAMP '2024-01-31' - INTERVAL 14 DAY THEN NULL ELSE raw_payload END AS raw_payload) FROM provider_event_log WHERE NOT received_at < TIMESTAMP '2024-01-31' - INTERVAL 90 DAY""",
)
def _retention(t):
    return X.retention(t.provider_event_log, AS_OF)


