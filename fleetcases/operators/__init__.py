"""DataFrame -> DataFrame operators."""

from fleetcases.operators.base import installed_base, installed_base_totals, restrict_to_cohort
from fleetcases.operators.cases import (build_cases, build_cases_legacy, enrich_cases,
                                        flag_case_boundaries)
from fleetcases.operators.events import (attach_events, cohort_masks, cohort_overlap, distinct_per,
                                         earliest_reboot, event_profile, first_case_after_event,
                                         histogram_of, in_all, latest_activity_per_device,
                                         next_case_after, recently_seen_hosts, repeat_cases,
                                         repeat_after_event, repeat_histogram, repeat_totals,
                                         span_overlap_check, tagged_events, totals_of)
from fleetcases.operators.lookup import (device_age_years, earliest_known, join_ignore_case,
                                         latest_known)
from fleetcases.operators.reports import (breakdown_with_total, case_breakdown,
                                          cases_and_missing, closed_single_case_devices,
                                          closed_single_case_in,
                                          closed_single_case_join, date_span,
                                          devices_and_missing, duplicate_keys,
                                          frequency_of_counts, frequency_of_sums,
                                          order_like_source, reconcile_sku)
from fleetcases.operators.signals import missing_signal_days

__all__ = [
    "flag_case_boundaries", "build_cases", "build_cases_legacy", "enrich_cases",   # O1-O4
    "missing_signal_days",                                                          # O5
    "breakdown_with_total", "cases_and_missing", "devices_and_missing",            # O7, O8
    "frequency_of_counts", "frequency_of_sums",                                     # O9
    "closed_single_case_devices", "closed_single_case_join", "closed_single_case_in",  # O10
    "latest_known", "earliest_known", "case_breakdown",                             # O11-O13
    "installed_base", "installed_base_totals", "join_ignore_case",                  # O14-O16
    "device_age_years",                                                             # O18
    "latest_activity_per_device", "tagged_events", "earliest_reboot",              # O19-O21
    "attach_events", "first_case_after_event", "repeat_after_event",               # O22-O24
    "repeat_histogram", "repeat_totals", "event_profile", "distinct_per",          # O24-O25
    "next_case_after", "repeat_cases", "histogram_of", "totals_of",                 # O23, O24 on one timeline
    "cohort_overlap", "cohort_masks", "in_all",                                     # O26
    "span_overlap_check", "recently_seen_hosts", "date_span", "reconcile_sku",     # O27-O31
    "restrict_to_cohort", "duplicate_keys", "order_like_source",                   # O32, QC, sort
]
