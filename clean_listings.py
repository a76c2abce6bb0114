"""``spark-submit [--py-files venuegrid.zip] clean_listings.py RAW OUT [--format csv]``"""

from venuegrid.plans.jobs import clean_listings

if __name__ == "__main__":
    clean_listings()
