"""Exploratory analysis of tables on Spark.

Every operator takes a DataFrame and column names and returns a DataFrame.
"""

from .functions.expressions import rounded, try_date, try_numeric
from .functions.roles import (
    categorical_columns,
    column_roles,
    datetime_columns,
    list_columns,
    numeric_columns,
)
from .functions.text import normalize_text, repair_mojibake
from .operators.aggregates import (
    aggregate,
    compare_abs_diff,
    compare_columns,
    compare_pct_diff,
    compare_pct_higher,
    compare_pct_lower,
    compare_ratio,
    count_column,
    multi_agg,
    numeric_range,
    row_count,
    scalar_agg,
    scenario,
)
from .operators.correlation import (
    corr_matrix,
    corr_pair,
    corr_pairs,
    corr_ranked,
    corr_strength,
    linear_fit,
)
from .operators.grouping import (
    bottom_n_groups,
    category_counts_with_null,
    explain_groups,
    group_agg,
    group_count,
    group_distribution,
    group_fewest_records,
    group_most_records,
    group_sorted,
    group_spread,
    metric_share,
    pie_slices,
    record_share,
    top_categories,
    top_contributor,
    top_n_groups,
)
from .operators.kpis import (
    best_roi_group,
    dimension_leaders,
    executive_summary,
    kpi_by_group,
    kpi_conversion_rate,
    kpi_cost_per_lead,
    kpi_profit,
    kpi_profit_margin,
    kpi_revenue_per_conversion,
    kpi_roi,
    summary_leaders,
)
from .operators.outliers import boxplot_stats, iqr_outliers, zscore
from .operators.profiling import (
    categorical_columns_for_charts,
    column_minmax,
    column_profiles,
    data_quality,
    dq_attention,
    dq_missing_only,
    dq_most_distinct,
    dq_totals,
    duplicate_rows,
    histogram,
    histogram_sqrt_bins,
    histograms,
    missing_cells,
    missing_chart,
    numeric_summary,
    overview,
    readiness,
    stat_summary,
)
from .operators.questions import (
    detect_aggregation,
    intent_phrases,
    intent_rules,
    mentioned_columns,
    previous_answer,
    recent_context,
    tag_by_phrases,
    tag_intent,
    valid_turns,
)
from .operators.selection import (
    between,
    filter_between,
    filter_count,
    filter_page,
    filter_rows,
    keyed_samples,
    numeric_sample,
    pair_sample,
    preview_rows,
    readonly_sql,
    sample_rows,
    top_correlated_points,
)
from .operators.statistics import (
    approximate_profiles,
    column_statistics,
    merge_statistics,
)
from .operators.timeseries import (
    daily_series,
    forecast_groups,
    linear_forecast,
    normalized_series,
    series_peak_low,
    trend,
    trend_change,
)
from .plans.report import category_charts, findings, profile_bundle, summary_blocks
from .sources.cleaning import (
    clean_table,
    coerce_mostly_numeric,
    drop_empty_columns,
    drop_empty_rows,
    drop_repeated_headers,
    promote_header,
    trim_strings,
)
from .sources.files import (
    clean_names,
    read_csv,
    read_dataset,
    read_parquet,
    read_tsv,
    with_row_position,
)
from .sources.sniffing import load_delimited, sniff_types
from .sources.store import Dataset, open_dataset, persist_dataset

__all__ = [name for name in dir() if not name.startswith("_")]
