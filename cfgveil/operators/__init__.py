"""DataFrame operators: sanitizing, detection, accounts, reports, backups and archives."""
