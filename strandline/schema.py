"""Schemas of a read archive, as DDL texts, and the fixed vocabularies of its columns."""

from __future__ import annotations


READS = (
    "read_id STRING NOT NULL, read_number BIGINT, start_sample BIGINT, channel INT, well SMALLINT, pore_type STRING, "
    "calibration_offset FLOAT, calibration_scale FLOAT, median_before FLOAT, end_reason STRING, end_reason_forced BOOLEAN, "
    "run_info INT, acquisition_id STRING, num_minknow_events BIGINT, tracked_scaling_scale FLOAT, tracked_scaling_shift FLOAT, "
    "predicted_scaling_scale FLOAT, predicted_scaling_shift FLOAT, num_reads_since_mux_change BIGINT, time_since_mux_change FLOAT, "
    "num_samples BIGINT, open_pore_level FLOAT, expected_open_pore_level FLOAT, selected_read_level FLOAT, "
    "source_file STRING, batch_idx INT, row_idx INT"
)
SIGNAL = "source_file STRING, read_id STRING, chunk_idx INT, samples INT, data BINARY"
RUN_INFO = (
    "acquisition_id STRING NOT NULL, acquisition_start_time TIMESTAMP, adc_max SMALLINT, adc_min SMALLINT, "
    "context_tags MAP<STRING,STRING>, experiment_name STRING, flow_cell_id STRING, flow_cell_product_code STRING, "
    "protocol_name STRING, protocol_run_id STRING, protocol_start_time TIMESTAMP, sample_id STRING, sample_rate INT, "
    "sequencing_kit STRING, sequencer_position STRING, sequencer_position_type STRING, software STRING, system_name STRING, "
    "system_type STRING, tracking_id MAP<STRING,STRING>"
)

#: Columns that older archives lack, with the values they are read with.
DEFAULTS = {"tracked_scaling_scale": 1.0, "predicted_scaling_scale": 1.0, "tracked_scaling_shift": 0.0, "predicted_scaling_shift": 0.0,
            "num_reads_since_mux_change": 0, "time_since_mux_change": 0.0, "open_pore_level": 0.0, "expected_open_pore_level": 0.0, "selected_read_level": 0.0}

# Fixed values of the archive format, in code order.
END_REASONS = [
    "unknown",
    "mux_change",
    "unblock_mux_change",
    "data_service_unblock_mux_change",
    "signal_positive",
    "signal_negative",
    "api_request",
    "device_data_error",
    "analysis_config_change",
    "paused",
]

#: Samples of a signal chunk, rows of a signal batch and of a reads batch.
CHUNK_SAMPLES, SIGNAL_BATCH_ROWS, READS_BATCH_ROWS = 102_400, 100, 1000
