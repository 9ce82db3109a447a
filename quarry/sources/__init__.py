"""Collections and where their documents come from and go to."""
