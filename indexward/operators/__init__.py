"""Set-based operators on catalog snapshots, state, logbook and activity frames."""
