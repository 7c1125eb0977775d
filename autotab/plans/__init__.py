"""autotab.plans"""
