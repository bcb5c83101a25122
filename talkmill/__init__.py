"""talkmill: conversation and tool-call analytics as PySpark DataFrame functions."""
