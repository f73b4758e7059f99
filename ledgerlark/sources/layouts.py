"""Declared layouts of the core tables, as DDL text."""

from __future__ import annotations

#: fixed values: the columns that operators read, by table
SCHEMAS: dict[str, str] = {
    "agent_runs": (
        "run_id string, organization_id string, session_id string, model_name string, total_input_tokens int, total_output_tokens int, total_tokens int, "
        "total_processing_time bigint, agent_id string, content string, event string, metrics_raw string, created_at timestamp"
    ),
    "billing_customers": (
        "organization_id string, status string, auto_charge_enabled boolean, billing_email string, card_brand string, card_last4 string, monthly_spend_limit "
        "decimal(10,2)"
    ),
    "billing_invoices": "id string, organization_id string, total decimal(12,2), status string, period_start timestamp, period_end timestamp, created_at timestamp",
    "broadcast_sends": "id string, broadcast_id string, status string, sent_at timestamp",
    "broadcasts": "id string, title string",
    "campaign_activities": "id string, organization_id string, campaign_id string, activity_type string, created_at timestamp",
    "campaign_companies": (
        "id string, organization_id string, campaign_id string, company_id string, status string, blocked_by_icp boolean, icp_profile_id string, created_at "
        "timestamp"
    ),
    "campaign_contacts": (
        "id string, organization_id string, campaign_id string, contact_id string, status string, source_type string, journey_state string, next_action_at "
        "timestamp, added_at timestamp"
    ),
    "campaign_emails": (
        "id string, organization_id string, campaign_id string, contact_id string, status string, message_id string, thread_id string, sent_at timestamp, "
        "opened_at timestamp, replied_at timestamp, reply_received_at timestamp, bounced_at timestamp, metadata string, created_at timestamp"
    ),
    "campaigns": (
        "id string, organization_id string, user_id string, name string, status string, metadata string, wizard_completed boolean, started_at timestamp, "
        "curated_companies string, emails_sent int, autosend_email boolean, autosend_linkedin boolean, autosend_min_confidence decimal(3,2), "
        "autosend_intents_text string, created_at timestamp"
    ),
    "chunks": "id string, organization_id string, file_id string, url string, chunk_text string, embedding array<float>",
    "companies": (
        "id string, organization_id string, name string, website string, profile_url string, location string, company_size string, employee_count int, "
        "industry_text string, icp_score string, processing_log string, icp_component_scores string, research_modules string, processing_status string, "
        "failure_reason string, blocked_by_icp boolean, manually_unblocked boolean, is_competitor boolean, phone string, specialities string, used_for_outreach "
        "boolean, outreach_count int, owner_user_id string, file_ids_text string, created_at timestamp"
    ),
    "company_contacts": "id string, organization_id string, company_id string, contact_id string, created_at timestamp",
    "contact_events": (
        "organization_id string, contact_id string, activity_type string, title string, source_event_key string, actor string, actor_user_id string, "
        "occurred_at timestamp"
    ),
    "contacts": (
        "id string, organization_id string, first_name string, last_name string, name string, email string, email_validation_response string, profile_url "
        "string, pipeline_stage string, do_not_contact boolean, stop_drafts boolean, unsubscribed_at timestamp, last_thread_id string, last_incoming_email_at "
        "timestamp, stage_updated_at timestamp, location string, skills string, specialities string, phone string, assigned_to_user_id string, "
        "processing_status string, job_title string, lead_score string, research string, ocean_traits string, disc_traits string, fit_score double, "
        "social_score double, created_at timestamp"
    ),
    "crm_list_members": "organization_id string, list_id string, company_id string, contact_id string, created_at timestamp",
    "crm_raw_records": "id string, organization_id string, raw_name string, extracted_company_id string, extracted_person_id string",
    "deal_activities": "id string, deal_id string, organization_id string, activity_type string, bumps_last_activity boolean, source_event_key string, created_at timestamp",
    "deal_tasks": (
        "id string, organization_id string, deal_id string, contact_id string, task_type string, status string, metadata string, assigned_to_user_id string, "
        "created_by_user_id string, completed_by_user_id string, due_date timestamp, completed_at timestamp, created_at timestamp"
    ),
    "deals": (
        "id string, organization_id string, company_id string, primary_contact_id string, stage_contact_id string, source_campaign_id string, owner_user_id "
        "string, name string, stage string, amount decimal(14,2), currency string, creation_source string, nurture_enabled boolean, snoozed_until timestamp, "
        "stage_updated_at timestamp, last_activity_at timestamp, closed_at timestamp, created_at timestamp"
    ),
    "discount_codes": "code string, discount_type string, max_uses int, expires_at timestamp",
    "discount_redemptions": "id string, code string, organization_id string, amount_discounted decimal(12,2), redeemed_at timestamp",
    "document_access_events": "id string, short_url_id string, event_type string, duration_seconds int, accessed_at timestamp",
    "email_copy_drafts": (
        "id string, organization_id string, contact_id string, company_id string, campaign_id string, status string, body string, subject string, thread_id "
        "string, send_status string, sent_at timestamp, metadata string, created_at timestamp"
    ),
    "email_reply_events": (
        "organization_id string, dedup_key string, email_id string, account_id string, thread_id string, contact_id string, campaign_id string, received_at "
        "timestamp, classification string, relevance string"
    ),
    "event_pages": "id string, organization_id string, title string, capacity int",
    "event_registrations": "id string, event_id string, organization_id string, email string, status string, registered_at timestamp",
    "file_links": "id string, organization_id string, file_id string",
    "icp_settings_rows": "organization_id string, icp_settings string",
    "linkedin_action_log": "id string, organization_id string, account_id string, action_type string, success boolean, campaign_id string, payload string, created_at timestamp",
    "linkedin_messages": "id string, organization_id string, chat_id string, direction string, body string, sent_at timestamp",
    "linkedin_threads": "id string, organization_id string, contact_id string, thread_origin string, thread_status string, last_message_at timestamp",
    "members": "organization_id string, user_id string, user_name string, status string, billable boolean, member_type string, starts_at timestamp, ends_at timestamp",
    "onboarding_events": "id string, organization_id string, user_id string, user_email string, to_status string, occurred_at timestamp",
    "organization": "id string, name string, deleted boolean, work_access_mode string, work_access_reason string, work_access_until timestamp, dispatch_suspended boolean",
    "organization_settings": "organization_id string, default_deal_amount decimal(14,2), default_deal_currency string, crm_pipeline_enabled boolean, crm_automation_enabled boolean",
    "outreach_candidates": "candidate_id string, organization_id string, profile_url string, name string, domain string",
    "projection_failures": "id string, organization_id string, contact_id string, resolved_at timestamp",
    "provider_event_log": (
        "id string, organization_id string, dedup_key string, provider string, event_type string, raw_payload string, occurred_at timestamp, received_at "
        "timestamp"
    ),
    "reengagement_sends": "id string, organization_id string, sequence_step string, sent_at timestamp, opened_at timestamp, clicked_at timestamp, converted_at timestamp",
    "reply_drafts": "id string, organization_id string, campaign_id string, channel string, intent string, confidence decimal(3,2)",
    "sequence_actions": (
        "id string, organization_id string, campaign_contact_id string, channel string, action_type string, status string, scheduled_at timestamp, retry_at "
        "timestamp, lease_expires_at timestamp, attempts int, review_task_id string"
    ),
    "short_urls": "id string, organization_id string, target_url string, expires_at timestamp, is_active boolean",
    "stored_files": "id string, organization_id string",
    "style_guidelines": "id string, lexical_fields string, dictionary string, emotions_text string, traits_text string",
    "suppressions": "email string, organization_id string, scope string",
    "tasks": (
        "id string, organization_id string, contact_id string, campaign_id string, company_id string, task_type string, status string, send_status string, "
        "sent_at timestamp, due_date timestamp, completed_at timestamp, created_at timestamp, created_by_user_id string, email_id string, thread_id string, "
        "channel string, body string, metadata string"
    ),
    "token_usage": (
        "id bigint, organization_id string, session_id string, provider string, model_name string, total_calls int, total_input_tokens int, total_output_tokens "
        "int, total_tokens int, tracking_start timestamp, tracking_end timestamp"
    ),
    "unmatched_replies": "id string, organization_id string, email_id string, resolution_status string, received_at timestamp",
    "usage": (
        "id string, organization_id string, session_id string, provider string, model_name string, api_calls int, input_tokens int, output_tokens int, "
        "total_tokens int, run_id string, usage_context string, campaign_id string, user_id string, invoice_id string, list_cost decimal(12,6), billed_cost "
        "decimal(12,6), metadata string, created_at timestamp"
    ),
    "workspaces": (
        "id string, name string, deleted boolean, onboarding_status string, activated_at timestamp, card_on_file boolean, company_website string, created_at "
        "timestamp"
    ),
}
