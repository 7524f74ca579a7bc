"""keelson: deployment and event data operators on Spark DataFrames.

Subpackages:
  functions  – scalar column expressions (paths, text)
  sources    – table readers, manifest decoding, property-file sink
  operators  – projections, joins, aggregates, windows, set ops
  plans      – fixed dimension tables, the deployment plan, registered queries
  streaming  – restart-safe hop, stateful readiness, streaming refresh

The operators are re-exported here: ``from keelson import resolve_properties``.
"""

from keelson.operators.aggregates import (
    all_of,
    all_running,
    collect_properties,
    duplicate_keys,
    first_success_within,
    property_lines,
    render_document,
    render_properties,
    resolve_properties,
    topology,
    topology_pages,
    topology_pieces,
    unique_index,
)
from keelson.operators.joins import (
    check_lookup,
    conditional_refresh,
    expand_rights,
    expand_template,
    keep_listed,
    missing_keys,
    observed_lookup,
    pending,
    pending_filtered,
    require_keys,
    strict_lookup,
)
from keelson.operators.select import (
    audit_responses,
    extract_groups,
    select_kind,
    split_responses,
    with_default,
    with_defaults,
)
from keelson.operators.sets import expand_instances, ordered_union, rejected_counts
from keelson.operators.windows import bounded_attempts, first_attempts, number_rows, running_totals
from keelson.plans.deployment import deployment_plan
from keelson.sources.cached import cached_items, quarantined, read_cached, write_cached
from keelson.sources.manifest import (
    decode_document,
    pack_manifest,
    pack_pages,
    quarantine_document,
    quarantine_manifest,
    unpack_manifest,
)
from keelson.sources.sinks import export_property_files, read_property_files, write_property_files
from keelson.streaming.hop import append_hop, file_stream, kafka_options
from keelson.streaming.readiness import readiness_stream
from keelson.streaming.refresh import refresh_changes, refresh_stream, snapshot

__version__ = "0.1.0"
