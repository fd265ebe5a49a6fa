"""Named reports and queries; each module has QUERIES (name: function of (spark, sf_dir)) and ORACLE_SQL."""
