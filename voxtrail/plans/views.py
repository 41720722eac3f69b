"""Views that read the given tables as trials, results, maps, samples and ledgers.

The text runs unchanged in Spark and in the checking engine; braces mark table
names and the two date expressions that differ.
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # one trial per embedding: 5 subjects x 2 sources x 5 runs x 3 valences
    "trials": """
SELECT vec_id, CAST(vec_id % 5 AS INT) AS subject,
       CASE WHEN vec_id % 2 = 0 THEN 'natural' ELSE 'ai' END AS source,
       CAST(floor(vec_id / 10) AS BIGINT) % 5 AS run,
       CASE label % 3 WHEN 0 THEN 'neutral' WHEN 1 THEN 'pleasant' ELSE 'unpleasant' END AS valence,
       label AS image, embedding
FROM {embeddings}""",
    # one accuracy per order line; 30 subjects, 17 regions
    "acc": """
SELECT CAST(o_custkey % 30 AS INT) AS subject, concat('roi', CAST(l_partkey % 17 AS INT)) AS roi,
       l_returnflag AS flag, l_linestatus AS status, CAST(l_linenumber AS INT) AS line,
       0.43 + l_discount * 0.9173051 + l_tax * 0.3137 AS accuracy
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "results": """
SELECT subject, roi, concat(flag, status) AS contrast, avg(accuracy) AS accuracy
FROM acc GROUP BY subject, roi, concat(flag, status)""",
    # the same cells for three pipelines
    "pipeline_results": """
SELECT concat('p', line % 3) AS pipeline, subject, roi, flag AS contrast,
       CASE WHEN status = 'F' THEN 'within' ELSE 'cross' END AS kind, avg(accuracy) AS accuracy
FROM acc GROUP BY concat('p', line % 3), subject, roi, flag, CASE WHEN status = 'F' THEN 'within' ELSE 'cross' END""",
    # four accuracies per subject, region and positive class
    "cells": """
SELECT subject, roi, CASE WHEN flag = 'R' THEN 'unpleasant' ELSE 'pleasant' END AS positive,
       CASE WHEN status = 'F' THEN CASE WHEN line % 2 = 0 THEN 'within_natural' ELSE 'within_ai' END
            ELSE CASE WHEN line % 2 = 0 THEN 'natural_to_ai' ELSE 'ai_to_natural' END END AS kind,
       avg(accuracy) AS accuracy
FROM acc GROUP BY 1, 2, 3, 4""",
    # a grid of voxels with two values and two label systems
    "stat_map": """
SELECT p_partkey AS voxel_id, CAST(p_partkey % 10 AS BIGINT) AS i,
       CAST(floor(p_partkey / 10) AS BIGINT) % 10 AS j, CAST(floor(p_partkey / 100) AS BIGINT) AS k,
       (p_retailprice - 949.37) * 0.0371372913 AS a, CAST(p_size AS DOUBLE) - 24.5 AS b,
       CAST(substring(p_brand, 7) AS INT) AS roi_id, p_brand AS brand, p_type AS parent, p_name AS name
FROM {part}""",
    # voxel values of eight subjects under two contrasts; not every subject has every voxel
    "subject_map": """
SELECT CAST(l_suppkey % 8 AS INT) AS subject, l_linestatus AS contrast, l_partkey AS voxel_id,
       avg((l_quantity - 24.17) * 0.037137291 + l_discount) AS value
FROM {lineitem} GROUP BY CAST(l_suppkey % 8 AS INT), l_linestatus, l_partkey""",
    # a time series per run and voxel; missing values where the line was returned with tax 0
    "bold": """
SELECT CAST(l_linenumber % 3 AS INT) AS run, l_partkey AS voxel_id, l_orderkey AS t,
       CASE WHEN l_returnflag = 'R' AND l_tax < 0.005 THEN NULL ELSE l_extendedprice * 0.0131713917 END AS value
FROM {lineitem}""",
    # value series per subject; a missing sample is NULL
    "samples": """
SELECT user_id AS subject, event_id, CAST({day} * 86400000 + {ms} AS BIGINT) AS t_ms, event_type,
       CASE WHEN event_type = 'error' THEN NULL ELSE value * 1.03719317 END AS value
FROM {events}""",
    "onsets": """
SELECT subject, event_id AS onset_id, t_ms AS onset_ms, CAST(event_id % 3 AS INT) AS emotion,
       CAST(event_id % 2 AS INT) AS ai
FROM samples WHERE event_type = 'signup'""",
    "ratings": """
SELECT l_partkey AS picture, CAST(l_suppkey % 6 AS INT) AS rater, p_type AS type,
       CASE WHEN p_size > 25 THEN 'ai' ELSE 'photo' END AS modality,
       l_quantity * 0.1731973 AS valence, l_extendedprice * 0.000171393 AS arousal
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    # stage events; some payloads were edited after hashing, one link in 500 was cut
    "ledger_body": """
SELECT event_id + 1 AS sequence, CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'started' END AS event,
       CAST(user_id AS BIGINT) AS subject, event_type AS stage,
       CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'passed' END AS status
FROM {events}""",
    # events of one subject and day as a run: 'view' is the fixation, 'signup' a stimulus
    "run_events": """
SELECT user_id AS subject, CAST({day} AS BIGINT) AS run, event_id, CAST({day} * 86400000 + {ms} AS BIGINT) AS t_ms,
       event_type AS kind, concat('S', CAST(event_id % 7 AS INT)) AS name
FROM {events}""",
    # one row per trial and feature, only for the check SQL; the plans use arrays
    "long_x": """
SELECT vec_id, subject, source, run, valence, image, concat('r', pos // 16) AS roi, (pos % 16)::INT AS pos,
       embedding[pos + 1]::DOUBLE AS x,
       CASE WHEN vec_id % 9 = 4 AND pos % 16 < 2 THEN NULL WHEN pos % 16 = 15 AND vec_id % 251 = 8 THEN NULL
            ELSE embedding[pos + 1]::DOUBLE END AS xn
FROM trials, (SELECT unnest(range(64)) AS pos)""",
    # frame-wise motion of ten runs; one rotation is constant inside a run
    "motion": """
SELECT CAST(o_custkey % 10 AS INT) AS run, o_orderkey AS t,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice * 0.00000113 END AS fd,
       o_totalprice * 0.0000317 AS trans_x, CAST(o_custkey % 7 AS DOUBLE) AS trans_y, CAST(o_custkey % 10 AS DOUBLE) AS rot_x
FROM {orders}""",
    # a value per voxel and frame, and a shared regressor per frame
    "glm_y": """
SELECT l_partkey % 50 AS voxel_id, l_orderkey % 40 AS t, avg(l_quantity * 0.731971 + l_tax) AS y
FROM {lineitem} GROUP BY l_partkey % 50, l_orderkey % 40""",
    "glm_x": """
SELECT o_orderkey % 40 AS t, avg(o_totalprice) * 0.0000113 AS x FROM {orders} GROUP BY o_orderkey % 40""",
}
