from signpost.operators.retries import error_taxonomy

MESSAGES = {
    "Rate limit hit": ("RateLimitError", True),
    "code 429 timeout": ("RateLimitError", True),
    "Request TIMED OUT": ("TimeoutError", True),
    "timeout on network": ("TimeoutError", True),
    "Connection refused": ("ConnectionError", True),
    "max 1500 tokens": ("ServerError", True),
    "got 504": ("ServerError", True),
    "401": ("AuthenticationError", False),
    "HTTP 403 forbidden": ("AuthenticationError", False),
    "404 not found": ("BadRequestError", False),
    "bad JSON": ("ParseError", False),
    "cannot parse": ("ParseError", False),
    "strange": ("RetryableError", True),
    "": ("RetryableError", True),
}


def test_taxonomy(spark):
    df = spark.createDataFrame([(m,) for m in MESSAGES], "error string")
    got = {r["error"]: (r["error_class"], r["retryable"]) for r in error_taxonomy(df).collect()}
    assert got == MESSAGES
