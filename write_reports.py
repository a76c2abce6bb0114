"""``spark-submit [--py-files venuegrid.zip] write_reports.py TABLES OUT``"""

from venuegrid.plans.jobs import write_reports

if __name__ == "__main__":
    write_reports()
