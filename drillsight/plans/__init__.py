"""Plan pieces shared by operators: skew-safe joins, dense ids, the click aggregate, views."""
