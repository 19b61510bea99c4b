"""mergelight: code-review analytics as Spark jobs.

DataFrame in, DataFrame out.  Every table carries ``job_id`` (one pull-request
review) or ``repo``, so that one Spark job reviews many pull requests at once.
"""
