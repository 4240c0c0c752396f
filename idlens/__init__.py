"""Identity-document analytics on Spark: every public function maps DataFrames
to DataFrames or Columns to Columns."""
