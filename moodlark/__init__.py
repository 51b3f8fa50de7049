"""moodlark: sentiment analytics over labelled posts, written as Spark jobs."""
