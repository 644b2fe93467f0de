"""beaconry: Spark jobs for monitoring feeds, public warnings, trade statistics and record exports."""
