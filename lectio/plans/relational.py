"""Scheduling, lookups and upserts: the state of sources and links as relations."""

from __future__ import annotations

from lectio.functions.dialect import Dialect
from lectio.plans.registry import query

#: The time that stands for now, so that results don't depend on the day.
NOW = "TIMESTAMP '2024-02-03 12:00:00'"
HOUR = 3_600_000_000
OK_HOURS, BROKEN_HOURS = 16, 96


def _sources(d: Dialect) -> str:
    """The state of each source: its latest event tells status and time. One in seven is a blog; a sign-up is a new source."""
    status = "CASE event_type WHEN 'error' THEN 404 WHEN 'signup' THEN 0 ELSE 1 END"
    return f"""SELECT user_id AS source_id, {status} AS status, CASE WHEN user_id % 7 = 0 THEN 'blog' ELSE 'personal' END AS sourcetype, {d.micros('ts')} AS last_checked
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM {d.table('events')}) AS e_ WHERE place = 1"""


def _due(d: Dialect, condition: str) -> str:
    """Sources that are due. Their order isn't numbered, as that would put all of them through one task; due_priority lists the first."""
    return f"SELECT source_id, status, last_checked FROM ({_sources(d)}) AS s_ WHERE sourcetype <> 'blog' AND {condition}"


def _older(d: Dialect, hours: int) -> str:
    return f"last_checked < {d.micros(NOW)} - {hours * HOUR}"


@query
def due_new(d: Dialect) -> str:
    return _due(d, "(status = 0 OR last_checked IS NULL)")


@query
def due_ok(d: Dialect) -> str:
    return _due(d, f"status = 1 AND {_older(d, OK_HOURS)}")


@query
def due_broken(d: Dialect) -> str:
    return _due(d, f"status > 1 AND {_older(d, BROKEN_HOURS)}")


#: Sources that are listed to be visited next; the limit is the feature.
NEXT = 200


@query
def due_priority(d: Dialect) -> str:
    """The sources to visit next: new ones, then healthy ones that are due, then broken ones."""
    tier = f"CASE WHEN status = 0 OR last_checked IS NULL THEN 1 WHEN status = 1 AND {_older(d, OK_HOURS)} THEN 2 WHEN status > 1 AND {_older(d, BROKEN_HOURS)} THEN 3 END"
    order = "tier, CASE WHEN tier = 1 THEN 0 ELSE last_checked END, source_id"
    return f"""SELECT source_id, tier, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS place
FROM (SELECT * FROM (SELECT *, {tier} AS tier FROM ({_sources(d)}) AS s_ WHERE sourcetype <> 'blog') AS t_ WHERE tier IS NOT NULL ORDER BY {order} LIMIT {NEXT}) AS n_"""


@query
def training_join(d: Dialect) -> str:
    """Documents with a judgement in full strength, for training."""
    return f"SELECT doc.doc_id, doc.lang, doc.n_chars, l.quality, CAST(floor(l.quality * 100 / 100) AS INT) AS positive FROM {d.table('documents')} doc JOIN {d.table('labels')} l ON doc.doc_id = l.doc_id WHERE l.toxic = 0"


@query
def upsert_latest(d: Dialect) -> str:
    """The last write of each key, and whether it was inserted once or updated."""
    return f"""SELECT user_id, event_type, value, {d.micros('ts')} AS written, CASE WHEN n > 1 THEN 'updated' ELSE 'inserted' END AS how
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM {d.table('events')}) AS e_ WHERE place = 1"""


@query
def offset_incremental(d: Dialect) -> str:
    """Documents beyond the offset that was reached, here that of the labelled ones of the first half."""
    return f"""SELECT doc_id, lang, source FROM {d.table('documents')}
WHERE doc_id > (SELECT coalesce(max(doc_id), -1) FROM {d.table('labels')} WHERE doc_id < (SELECT max(doc_id) / 2 FROM {d.table('documents')}))"""


@query
def least_recent_names(d: Dialect) -> str:
    """The twenty names that were searched least recently; never is the least recent."""
    return f"""SELECT c_name AS name, coalesce({d.micros('max(o_orderdate)')}, 0) AS last_searched FROM {d.table('customer')} LEFT JOIN {d.table('orders')} ON o_custkey = c_custkey
GROUP BY c_custkey, c_name ORDER BY last_searched, name LIMIT 20"""


@query
def insert_absent_names(d: Dialect) -> str:
    """Names that aren't known yet, to be inserted once each."""
    return f"""SELECT DISTINCT concat('Name', CAST(c_nationkey * 100 + c_custkey % 97 AS STRING)) AS name FROM {d.table('customer')} c
WHERE NOT EXISTS (SELECT 1 FROM {d.table('supplier')} s WHERE s.s_nationkey * 100 + s.s_suppkey % 97 = c.c_nationkey * 100 + c.c_custkey % 97)"""


@query
def membership_3valued(d: Dialect) -> str:
    """Whether a customer is known to order, known not to (a negative account), or unknown."""
    return f"""SELECT c_custkey, CASE WHEN y.k IS NOT NULL THEN 'yes' WHEN n.k IS NOT NULL THEN 'no' ELSE 'unknown' END AS is_name FROM {d.table('customer')}
LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM {d.table('orders')}) y ON y.k = c_custkey LEFT JOIN (SELECT c_custkey AS k FROM {d.table('customer')} WHERE c_acctbal < 0) n ON n.k = c_custkey"""


_CODES = [(200, "ok"), (301, "moved"), (304, "not modified"), (403, "forbidden"), (404, "not found"), (408, "timeout"), (500, "server error"), (900, "unknown error"), (902, "too many redirects"), (903, "too large"), (905, "no connection")]


@query
def http_status_class(d: Dialect) -> str:
    """Status codes with their messages; a code without one gets a default."""
    names = " UNION ALL ".join(f"SELECT {c} AS code, '{m}' AS message" for c, m in _CODES)
    pick = " ".join(f"WHEN {i} THEN {c}" for i, (c, _) in enumerate([*_CODES, (418, "")]))
    return f"""SELECT e.event_id, e.code, coalesce(m.message, 'error ' || CAST(e.code AS STRING)) AS message, CASE WHEN e.code >= 900 THEN 'local' WHEN e.code >= 400 THEN 'broken' WHEN e.code >= 300 THEN 'moved' ELSE 'fine' END AS class
FROM (SELECT event_id, CASE event_id % 12 {pick} END AS code FROM {d.table('events')}) e LEFT JOIN ({names}) m ON m.code = e.code"""


@query
def retry_links(d: Dialect) -> str:
    """Links with an error that were found in the last five days before now, which are tried again."""
    return f"SELECT event_id AS link_id, user_id AS source_id FROM {d.table('events')} WHERE event_type = 'error' AND {d.micros('ts')} > {d.micros(NOW)} - {5 * 24 * HOUR}"


@query
def dead_transition(d: Dialect) -> str:
    """Status after each check: the same error twice in a row, under 900, marks a source as dead (9)."""
    return f"""SELECT event_id, user_id AS source_id, CASE WHEN status > 1 AND status = before THEN 9 ELSE status END AS status
FROM (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, CASE event_type WHEN 'error' THEN 404 ELSE 1 END AS status FROM {d.table('events')}) AS a_) AS b_"""


@query
def new_link_cap(d: Dialect) -> str:
    """Links of a source in order, the first fifty to be processed and the others marked as seen."""
    return f"SELECT event_id AS link_id, user_id AS source_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 50 THEN 0 ELSE 1 END AS status FROM {d.table('events')}"


@query
def hibernated_sources(d: Dialect) -> str:
    """Sources by the age of their last check in days; a year makes one fit to be found anew. Here an hour stands for a day."""
    return f"SELECT source_id, age, CASE WHEN age > 365 THEN 'forget' ELSE 'keep' END AS action FROM (SELECT source_id, CAST(floor(({d.micros(NOW)} - last_checked) / {HOUR}e0) AS INT) AS age FROM ({_sources(d)}) AS s_) AS a_"


@query
def docs_per_source(d: Dialect) -> str:
    """Documents, languages and largest document of each source."""
    return f"SELECT source, count(*) AS n_docs, count(DISTINCT lang) AS n_langs, max(n_chars) AS largest, min(doc_id) AS first_doc FROM {d.table('documents')} GROUP BY source"
