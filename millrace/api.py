"""Everything public under one name, with prefixed aliases of the same objects."""

from __future__ import annotations

from .functions.cleaning import date_labels, fix_column_names, strip_quotes, today_labels
from .functions.dates import to_date, to_datetime
from .functions.gazetteers import Gazetteer, health_facilities, municipalities
from .functions.health_numbers import flag_phn, mask_phn
from .functions.known_names import flag_known_names, mask_known_names
from .functions.linkage import linkage_id
from .functions.person_names import apply_name_rules, default_rules, detect_person_names, flag_person_names, mask_person_names
from .operators.balance import compare_balance
from .operators.boost import boost_data, detect_dates
from .operators.crosstab import cross_table, crosstab_long
from .operators.routing import google_travel, travel
from .operators.summary import category_levels, category_summary, continuous_stats, continuous_summary
from .operators.typing import data_type_table, data_types
from .operators.uniqueness import check_unique, count_unique_categories, duplicate_values, get_duplicates
from .plans.engine import check_engine, require_modules, setup_engine
from .sources.importing import read_csv, read_tables, read_xlsx
from .sources.store import load_table, save_table

ALIASES = {
    f"mill_{name}": value
    for name, value in list(globals().items())
    if callable(value) and getattr(value, "__module__", "").startswith("millrace.")
}
globals().update(ALIASES)
__all__ = sorted([*ALIASES, *(name.removeprefix("mill_") for name in ALIASES)])
