"""Document-evidence analytics on Spark: trust, ledgers, URL policy, HTML corpora, layout and edit logs as DataFrame operators."""
