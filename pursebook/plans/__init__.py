"""Plan shapes that stay balanced when one key holds much of the data."""
