"""Registry of whole queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import catering, experiments, fantasy, games, intake, metrics, profiles, real_estate, startups, tickets

QueryFn = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, QueryFn]:
    return {
        "payer_share": fantasy.payer_share,
        "payer_share_by_group": fantasy.payer_share_by_group,
        "payer_share_by_group_window": partial(fantasy.payer_share_by_group, window_form=True),
        "purchase_stats": fantasy.purchase_stats,
        "zero_amount_share": fantasy.zero_amount_share,
        "item_popularity": fantasy.item_popularity,
        "group_activity": fantasy.group_activity,
        "listing_activity": real_estate.listing_activity,
        "listing_seasonality": real_estate.listing_seasonality,
        "listings_monitor": real_estate.listings_monitor,
        "tickets_clean": tickets.tickets_clean_report,
        "revenue_caps": tickets.revenue_caps,
        "season_mix": tickets.season_mix,
        "season_unit_revenue": tickets.season_unit_revenue,
        "daily_dynamics": tickets.daily_dynamics,
        "weekday_cycle": tickets.weekday_cycle,
        "day_type_cycle": tickets.day_type_cycle,
        "region_leaders_by_events": partial(tickets.region_leaderboard, by="events_count"),
        "region_leaders_by_orders": partial(tickets.region_leaderboard, by="orders_count"),
        "partner_leaders_by_events": partial(tickets.partner_leaderboard, by="events_count"),
        "partner_leaders_by_orders": partial(tickets.partner_leaderboard, by="orders_count"),
        "partner_leaders_by_revenue": partial(tickets.partner_leaderboard, by="ticket_revenue"),
        "first_last_change": tickets.first_last_change,
        "overlap_percent": tickets.overlap_percent,
        "welch_orders": tickets.welch_orders,
        "welch_order_gap": tickets.welch_order_gap,
        "order_gap": tickets.order_gap,
        "funding_clean": startups.funding_clean_report,
        "funding_terms": startups.funding_terms,
        "market_tiers": startups.market_tiers,
        "iqr_outliers": startups.iqr_outliers,
        "active_years": startups.active_years,
        "funding_types": startups.funding_types,
        "yearly_rounds": startups.yearly_rounds,
        "growth_segments": startups.growth_segments,
        "segment_year_matrix": startups.segment_year_matrix,
        "growing_segments_by_year": startups.growing_segments_by_year,
        "return_ratio": startups.return_ratio,
        "venues_clean": catering.venues_clean_report,
        "hours_flag_check": catering.hours_flag_check,
        "category_counts": catering.category_counts,
        "district_counts": catering.district_counts,
        "district_category_mix": catering.district_category_mix,
        "chain_by_category": catering.chain_by_category,
        "rating_by_category": catering.rating_by_category,
        "rating_spread": catering.rating_spread,
        "seats_by_category": catering.seats_by_category,
        "large_venues": catering.large_venues,
        "bill_by_district": catering.bill_by_district,
        "rating_by_price": catering.rating_by_price,
        "top_chains": catering.top_chains,
        "top_chains_categories": catering.top_chains_categories,
        "association_table": catering.association_table,
        "games_clean": games.games_clean,
        "score_bins": games.score_bins,
        "top_platforms": games.top_platforms,
        "games_profile": games.games_profile,
        "games_values": games.games_values,
        "null_profile": profiles.null_profile_venues,
        "missing_report": profiles.missing_report,
        "null_totals": profiles.null_totals_venues,
        "marker_profile": profiles.marker_profile,
        "duplicate_profile": profiles.duplicate_profile,
        "duplicate_lines": profiles.duplicate_lines,
        "cleaning_audit": tickets.cleaning_audit,
        "event_value_describe": profiles.event_value_describe,
        "event_value_summary": profiles.event_value_summary,
        "event_value_histogram": profiles.event_value_histogram,
        "event_value_boxplot": profiles.event_value_boxplot,
        "sessions_per_user": experiments.sessions_per_user,
        "top_user_sessions": experiments.top_user_sessions,
        "sessions_daily": experiments.sessions_daily,
        "pages_per_first_session": experiments.pages_per_first_session,
        "good_sessions_daily": experiments.good_sessions_daily,
        "ab_sample_size": experiments.ab_sample_size,
        "ab_sample_size_grid": experiments.ab_sample_size_grid,
        "ab_balance": experiments.ab_balance,
        "group_pct_diff": experiments.group_pct_diff,
        "ab_overlap": experiments.ab_overlap,
        "ab_device_balance": experiments.ab_device_balance,
        "ab_region_balance": experiments.ab_region_balance,
        "ab_success": experiments.ab_success,
        "ab_ztest": experiments.ab_ztest,
        "site_overlap": experiments.site_overlap,
        "site_balance": experiments.site_balance,
        "site_conversion": experiments.site_conversion,
        "site_ztest": experiments.site_ztest,
        "reading_dedupe_audit": experiments.reading_dedupe_audit,
        "reading_city_stats": experiments.reading_city_stats,
        "welch_by_group": experiments.welch_by_group,
        "dau": metrics.dau,
        "conversion_daily": metrics.conversion_daily,
        "avg_check": metrics.avg_check,
        "ltv_top_venues": metrics.ltv_top_venues,
        "ltv_top_dishes": metrics.ltv_top_dishes,
        "retention": metrics.retention,
        "retention_monthly": metrics.retention_monthly,
        "dau_bitmaps": metrics.dau_bitmaps,
        "retention_bitmaps": metrics.retention_bitmaps,
        "overlap_bitmaps": metrics.overlap_bitmaps,
        "talk_counts": metrics.talk_counts,
        "talk_by_conference": metrics.talk_by_conference,
        "talk_filter": metrics.talk_filter,
        "talks_top_laughter": metrics.talks_top_laughter,
        "top_tags": metrics.top_tags,
        "top_tags_by_views": partial(metrics.top_tags, by="views"),
        "speakers_top": metrics.speakers_top,
        "csv_orders": intake.csv_orders,
        "csv_row_counts": intake.csv_row_counts,
        "csv_dirty_funding": intake.csv_dirty_funding,
        "csv_gzip_events": intake.csv_gzip_events,
        "zip_events": intake.zip_events,
        "csv_inferred": intake.csv_inferred,
        "csv_text_dates": intake.csv_text_dates,
        "catalog_orders": intake.catalog_orders,
    }


def all_oracle_sql() -> dict[str, str]:
    from .oracle import SQL
    return dict(SQL)
