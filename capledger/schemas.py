"""Schemas of the records, as DDL."""

FLOW = (
    "record_type string, company_name string, stock_code string, source_page string, subscription_date string, subscriber_name string, shares_subscribed double, amount_subscribed double, "
    "price_per_share double, event_context string, post_event_total_shares double, post_event_total_capital double, payment_method string, subscription_ratio string, evidence_text string, notes string"
)
SNAPSHOT = (
    "record_type string, company_name string, stock_code string, source_page string, snapshot_date string, snapshot_type string, total_shares double, total_capital double, shareholder_name string, shares_held double, "
    "capital_contribution double, shareholding_ratio string, snapshot_order int, shareholder_type_detail string, is_original_founder string, evidence_text string, notes string"
)
INVESTOR = (
    "investor_original_name string, investor_short_name string, investor_type string, is_pevc string, investment_amount double, shares_acquired double, shareholding_ratio_after_event string, exit_status_before_ipo string"
)
EVENT = (
    "event_order int, event_date string, date_type string, event_type string, disclosed_round string, inferred_round string, round_inference_basis string, total_investment_amount double, currency string, share_price double, "
    f"pre_money_valuation double, post_money_valuation double, valuation_basis string, investors array<struct<{INVESTOR.replace(' ', ': ').replace(',: ', ', ')}>>, source_section string, source_page string, evidence_text string, notes string, confidence string"
)
COMPANY_LIST = (
    "sample_id string, company_short_name string, company_full_name string, stock_code string, exchange string, board string, listing_date string, ipo_year int, source_platform string, source_page_url string, prospectus_title string, "
    "prospectus_url string, prospectus_version string, prospectus_date string, download_status string, parse_status string, locate_status string, extract_status string, review_status string, notes string"
)
#: A JSON record of either type, every field as text, so that a bad number is found and not lost.
RAW_RECORD = ", ".join(dict.fromkeys(f"{f.split()[0]} string" for ddl in (FLOW, SNAPSHOT) for f in ddl.split(", ")))
