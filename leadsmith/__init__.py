"""leadsmith: contact and posting data preparation as Spark DataFrame operators.

Every public operator is a pure ``DataFrame -> DataFrame`` function (usable with
``DataFrame.transform``) built from Spark SQL expressions, joins, aggregates and
windows, so Catalyst can prune, push down and plan the work.

Sub-packages:

* ``sources``   — table loaders, sinks, lookup lists, the captured-page source
* ``functions`` — column expressions (text, URL, e-mail, names)
* ``operators`` — filters, keep-first, anti-joins, extraction, keyed table
  changes, mailbox selection, scoring, outbox, audit
* ``plans``     — composite flows and the registered queries
* ``streaming`` — incremental ingest and streaming keep-first
"""

from leadsmith.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
