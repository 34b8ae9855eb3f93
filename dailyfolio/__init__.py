"""dailyfolio: personalised paper digests for many users, as Spark DataFrame jobs.

Operators take DataFrames and return lazy DataFrames. Anything that depends on the
calendar takes an explicit ``as_of`` date, so a run can be repeated or backfilled.
"""
